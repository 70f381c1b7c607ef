"""Main text by blocks: nothing of an article goes, and nothing else stays."""

import numpy as np

from sparkwake.llm import htmltext


def words(n):
    return " ".join(["word"] * n)


def sizes(page):
    return [len(x.split()) for x in htmltext.main_text(page).split("\n\n")] if htmltext.main_text(page) else []


def test_every_length_of_a_neighbour():
    for a in range(1, 201):
        for b in (1, 2, 7, 40, 200):
            assert sizes(f"<article><h1>A title</h1><p>{words(a)}<p>{words(b)}</article>") == [2, a, b]
            assert sizes(f"<body><nav><a href=x>m</a></nav><h1>A title</h1><p>{words(a)}<p>{words(b)}<p>{words(20)}<footer>f</footer>") == [2, a, b, 20]


def test_names_of_classes():
    long = f"<p>{words(40)}<p>{words(60)}"
    assert sizes(f'<article><h1>T</h1><div class="story-form">{long}</div></article>') == [1, 40, 60]
    assert sizes(f'<body><div class="page-header-layout"><h1>T</h1>{long}</div>') == [1, 40, 60]
    assert sizes(f'<div class="has-sidebar"><article><h1>T</h1>{long}</article></div>') == [1, 40, 60]
    assert sizes(f'<div class="left-sidebar">{long}</div><article><h1>T</h1>{long}</article><div class="post-comments"><article class="comment">{long}</article></div>') == [1, 40, 60]
    assert sizes(f'<form id="aspnetForm"><h1>T</h1>{long}</form>') == [1, 40, 60]
    assert sizes(f"<form>{long}</form><h1>T</h1>{long}") == [1, 40, 60]
    assert sizes(f'<article>{long}<div class="ad">{long}</div><div class="cookie-box">{long}</div><aside>{long}</aside><section id="comments">{long}</section></article>') == [40, 60]
    assert sizes("<article>Short text</article>") == [2] and sizes("<article><p>a<p><a href=x>link</a></article>") == [1, 1]


def test_slugs_keep_their_text():
    long = f"<p>{words(40)}<p>{words(60)}"
    for w in sorted(htmltext.CLEAR_WORDS | htmltext.BOILER_WORDS):
        for slug in (f"{w}-reform", f"the-{w}", f"why-a-{w}-matters", f"{w}-economy-2024"):
            assert sizes(f'<article><h1>T</h1><h2 id="{slug}">Two words</h2>{long}</article>') == [1, 2, 40, 60], slug
            assert sizes(f'<article><h1>T</h1><section id="{slug}"><h2>Two words</h2>{long}</section></article>') == [1, 2, 40, 60], slug
        assert sizes(f'<article><h1>T</h1><h2 id="{w}">Two words</h2>{long}</article>') == [1, 2, 40, 60], w
    for opening in ('article class="advert-study"', 'div id="newsletter-article"', 'article id="subscription-economy"', 'div id="cookie-recipes"'):
        assert sizes(f"<{opening}><h1>T</h1>{long}</{opening.split()[0]}>") == [1, 40, 60], opening
    for opening in ('section id="comments"', 'section id="post-comments"', 'div id="comment-list"', 'section class="newsletter-signup"', 'div id="cookie-banner"', 'div class="advert-slot-1"'):
        assert sizes(f"<article><h1>T</h1>{long}</article><{opening}>{long}</{opening.split()[0]}>") == [1, 40, 60], opening


def test_tree():
    tree = htmltext.tree()
    assert tree == htmltext.prune(htmltext.grow(*htmltext.labelled(1)), *htmltext.labelled(2))

    def used(node):
        return set() if isinstance(node, bool) else {htmltext.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert {"links", "words"} <= used(tree)
    x, y = htmltext.labelled(9)
    keep = np.array([htmltext._keep(tree, r) for r in x.tolist()])
    weight = x[:, 0]
    assert (weight * (keep & (y > 0))).sum() >= 0.98 * (weight * (y > 0)).sum()
    assert (weight * (~keep & (y == 0))).sum() >= 0.98 * (weight * (y == 0)).sum()


def test_links_within_an_article():
    for around in ("<p><a>w w</a></p>", "<p>w w w</p>", "<div>w w w w</div>", "<ul><li><a>w</a><li>w w</ul>"):
        for n in (1, 5, 20, 100):
            for linked in (0, n // 3, n // 2):
                for tag in ("p", "div"):
                    page = f"<article><h1>T</h1>{around}<{tag}><a>{words(linked)}</a> {words(n - linked)}</{tag}>{around}</article>"
                    assert sum(sizes(page)) == 1 + n + 2 * around.count("w")


def test_long_pages():
    page = "<article>" + "".join(f"<form><input></form><div class='x'><p>{words(5)} <a>l</a></p></div>" for _ in range(20_000)) + "</article>"
    assert len(htmltext.main_text(page).split("\n\n")) == 20_000
    assert htmltext.main_text("<div>" * 20_000 + "<p>deep") == "deep" and htmltext.main_text("<" * 50_000)[:2] in ("<<", "")
