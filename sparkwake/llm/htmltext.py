"""Main text of HTML pages: flat text blocks, told apart by a decision tree over a block and its neighbours.

A page becomes a flat list of text blocks, cut at block-level tags. Each has its number of words, the share of
them that links hold, the same two figures of the block before and after, the kind of tag it stands in, and two marks
of the page's own: how clearly its ancestors call themselves something else than the article, and whether it lies
inside or outside of an element that calls itself the article. A decision tree, grown by Gini impurity from a small
labelled table and cut back where a second one is told no worse without, keeps a block or drops it.

The first mark is 2 where an ancestor is such an element (menu, footer, sidebar, dialog, a form that holds no
article), has such a role, is hidden, or has such a class or id; and 1 where within the article only a part of a
compound name says so ("story-form"), which the figures then decide upon. Names are taken apart at white space first:
"page-header-layout" is no header. An article inside of an element with a compound name counts anew.

Within a block character references are decoded, runs of white space (line breaks by <br> too) become one space,
and the ends are trimmed; kept blocks are joined by two line feeds. Nothing is cut or capped, however long a page is;
the time that a page takes grows with its length.

Defined results: null or empty html, or a page without main text, gives empty text; text outside of any tag is a
block; an unclosed script, style or HTML comment reaches to the page's end, as browsers read it; repeated rows
each get a row; an empty table gives no rows. Columns besides the id, the url and the html are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--(?:(?!-->).)*+(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$|[^<]++|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
_BEGIN = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title head datalist".split())
_RAW_TEXT = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog button label legend fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids that say the same wherever they stand.
CLEAR_WORDS = frozenset("cookie cookies consent gdpr adv advert adverts advertisement sponsor sponsored sponsors newsletter comment comments commentlist disqus breadcrumb breadcrumbs navbar masthead pagination pager copyright subscribe subscription signup promoted".split())
#: Those that do so as the whole of a name, or as the first or last part of it.
BOILER_WORDS = frozenset("nav navigation menu header topbar footer bottombar sidebar aside rail notice notices banner alert popup modal overlay ad ads promo promotion form login search disclaimer respond reply replies discussion share sharing social related recommended toolbar widget widgets skip".split())
#: Parts that make a name one about the page, as in "has-sidebar".
ABOUT_WORDS = frozenset("has no with without is not hide show layout page wrapper container".split())
#: Parts of a name that say what kind of box something is, not what it holds.
BOX_WORDS = frozenset("section list area container block box bar wrapper inner outer title head item items thread count link links button slot unit top bottom left right row col group panel form policy".split())
#: Parts that only a sentence has: ids made of a heading's words.
SENTENCE_WORDS = frozenset("a an and are as at by can for from how if in into it of on or our so that the their this to we what when where why will you your".split())
#: Elements whose ids and classes say nothing, and others whose classes may be slugs of what they are about, as any id may be.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SLUGGED = frozenset(("article", "section"))
MAIN_WORDS = frozenset("article articlebody post content entry story main maincontent".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())


@dataclass
class Block:
    text: str
    words: int
    links: float  # share of the words within links
    mark: int  # 0, 1 or 2
    inside: bool
    paragraph: bool
    heading: bool


def _named(value: str, in_main: bool, slugs: bool = False) -> tuple[int, bool]:
    """How a class or id marks an element: 0 not, 1 perhaps, 2 by a compound name, 3 clearly; and as the main part.

    Where names may be slugs, a compound says what its last part is, words for boxes aside: "post-comments" are comments,
    "copyright-reform" is no copyright notice.
    """
    mark, main = 0, False
    for token in value.split():
        parts = [w.lower() for w in _WORDS.findall(token)]
        if not parts or set(parts) & ABOUT_WORDS:
            continue
        if slugs and len(parts) > 1:
            if len(parts) > 3 or set(parts) & SENTENCE_WORDS:
                continue
            while len(parts) > 1 and parts[-1] in BOX_WORDS:
                parts.pop()
            parts = parts[-1:]
        if set(parts) & CLEAR_WORDS or len(parts) == 1 and parts[0] in BOILER_WORDS and not (in_main and parts[0] == "header"):
            mark = 3
        elif len(parts) > 1 and (parts[0] in BOILER_WORDS or parts[-1] in BOILER_WORDS):
            mark = max(mark, 1 if in_main else 2)
        elif set(parts) & MAIN_WORDS:
            main = True
    return mark, main


def _marks(tag: str, attrs: str, in_main: bool) -> tuple[int, bool]:
    """How an element marks its content as something else than the article (0 to 3), and whether as the main part."""
    mark, main = 3 * (tag in BOILER_TAGS or tag == "header" and not in_main), tag in ("article", "main")
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                mark = 3
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    mark = 3
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    mark = 3
                main |= value.lower() in ("main", "article")
            elif name in ("class", "id"):
                if tag in ("body", "html", "main") or tag in HEADINGS:
                    continue
                own, named = _named(value, in_main, name == "id" or tag in SLUGGED)
                mark, main = max(mark, own if tag != "article" or own == 3 else 0), main or named
            elif value.lower() == "articlebody":
                main = True
    return mark, main and not mark


def _wrapping_forms(page: str) -> tuple[list[int], list[int]]:
    """Places where forms end, and where an article, a main part or a first heading begins."""
    return [m.start() for m in _FORM_END.finditer(page)], [m.start() for m in _BEGIN.finditer(page)]


def blocks(page: str) -> tuple[list[Block], bool]:
    """The flat text blocks of a page, and whether the page names a main part."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, mark, inside: of the element or one around it
    mark, inside, has_main, forms = 0, False, False, None
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    tag_now = ""
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                own = len(_html.unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(text, words, min(1.0, own / words), min(mark, 2), inside, tag_now in PARAGRAPH, len(tag_now) == 2 and tag_now[0] == "h" and tag_now != "hr"))
            parts, linked = [], []

    def pop(to: int) -> None:
        nonlocal mark, inside, tag_now
        del stack[to:]
        mark, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        tag_now = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")

    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                parts.append(m[0])
                if in_link:
                    linked.append(m[0])
            continue
        tag, closing, attrs = tag.lower(), bool(m[1]), m[3]
        if tag in RAW and not closing:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            if tag in BLOCK or tag in ("head", "title"):
                flush()
            if tag in _RAW_TEXT or tag != "head":
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else end
            else:  # a head ends at its own end or where the body begins
                close = re.compile(r"</head(?=[\s/>])[^>]*>|(?=<body(?=[\s/>]))", re.I).search(page, pos)
                pos = close.end() if close else pos
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1)) if closing or not in_link else in_link
            if not closing:
                linked.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            if tag in VOID:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if not block and any(t in BLOCK for t, _, _ in stack[k + 1 :]):
                        break  # an inline end tag closes no block
                    if not block and stack[k][1] != (stack[k - 1][1] if k else 0):
                        flush()
                    pop(k)
                    break
            if block:
                in_link = 0
        elif tag not in VOID:
            if block:
                in_link = 0
                # a block ends an open paragraph; an item ends the item before it
                for k in range(len(stack) - 1, -1, -1):
                    t = stack[k][0]
                    if t == "p" or t == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                        pop(k)
                        break
                    if t in BLOCK:
                        break
            own, main = _marks(tag, attrs, inside)
            if tag == "form":
                ends, begins = forms = forms or _wrapping_forms(page)
                at = bisect_left(begins, pos)
                wraps = at < len(begins) and begins[at] < (ends[e] if (e := bisect_left(ends, pos)) < len(ends) else end)
                own = 0 if wraps else 3
            around = 0 if tag in ("article", "main") and mark == 2 else mark
            if not block and own > around:
                flush()
            if block or own:
                stack.append((tag, max(around, own), inside or main))
                has_main |= main and not around
                mark, inside = stack[-1][1], stack[-1][2]
                if block:
                    tag_now = tag
    flush()
    return out, has_main


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark", "outside", "inside", "paragraph", "heading")


def features(found: list[Block], has_main: bool) -> list[list[float]]:
    rows = []
    none = Block("", 0, 0.0, 0, False, False, False)
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        rows.append([b.words, b.links, before.words, before.links, after.words, after.links, float(b.mark), float(has_main and not b.inside), float(b.inside), float(b.paragraph), float(b.heading)])
    return rows


#: Page layouts that the labelled tables are made from, a letter for each block:
#: T title, P paragraph, S short paragraph, D text without a paragraph, E such text with links, L item with some links, A paragraph that is a
#: link, Q paragraph in a name that perhaps is something else's (all main text); M menu entry, B bar of links, N note, C long note, R read-more
#: link, F short form text in such a name, K line of rights (all of them not).
#: Before the bar stands what surrounds the letters: a where an element is the article, else u; upper-case runs after
#: a dot lie outside of it, and those after a comma lie in a marked element.
LAYOUTS = (
    "a:,MMMM,N:TPPSPPDP:,K", "a:.MMM.N:TSPPPPLLLP:.K", "a:,B,C:TPQQPPSF:,NNC.K", "a:.B.C:TTPPDDPPSS:.MMMM,C", "a:,MM:P:,K", "a:,M:TS:.N", "a::TPLLLLPPP:.MMM.C,CC",
    "a:,MMMMM,N:TPFQPPPS:,CCC", "a:.N:DDDD:.B", "a:,B:TSSSSSS:,B", "a:.M,N:TPPPPPPPPPPP:,CCCC,K", "a:,N:TPQPPFPP:,MMM,K",
    "a::D:", "a::TD:", "a:,M:TPD:,K", "a:.B:DD:.K", "a:,MM:PSD:", "a:.M:TD:.N", "u::D:", "u::DD:", "u::TD:",
    "u:MMMM:TPPPSPPP:K", "u:MMMMM:TPPDPSPP:MMM", "u:B:TPPPP:BK", "u::TPPSSPPP:", "u:MM:PPPP:RMM", "u:B:DDDD:K", "u::TS:", "u:,MMMM,N:TPPPPSP:,NK", "u:,C:TPPP:,CC,K", "u:BB:TPLPPP:MMMM", "u::D:", "u::S:", "u:MMM:TSPPSPP:MMMK", "u:,M,N:PPPPQPP:,FC", "u:M:TSSPP:K",
    "u:MMMM:TPLLPPP:MMK", "u:B:TPPLPPLP:RMM", "u:MM:PLPPLLP:MMM", "u:MMNMM:TPPP:MMNMM", "u:MNM:TPPPP:MNMM", "u:MMM:TPPSP:MNMBM", "u:MM:TDDD:MNM", "a::TEPEDE:", "a::TADAD:", "a:,MM:ADPADAE:,K", "a:.B:TAEADD:,C", "a::TALDAD:.M", "a:,MM:TEDE:.K", "a:.B:EPDEE:,C", "a::TPLP:", "a:,MM:TPALPA:,K", "a:.B:TAPLAP:.R", "a::APPA:", "a:,MMM:TPAAPP:,K", "a:.MM:TAAPPA:.MK",
)
#: Letter -> least and most words, least and most share of links, whether in a paragraph, whether a heading.
BLOCKS = {
    "T": (1, 16, 0, 0, 1, 1), "P": (1, 240, 0, 0.3, 1, 0), "S": (1, 6, 0, 0, 1, 0), "D": (2, 120, 0, 0.2, 0, 0), "E": (2, 60, 0.2, 0.7, 0, 0), "L": (2, 30, 0.2, 1, 1, 0), "Q": (25, 200, 0, 0.2, 1, 0),
    "A": (1, 9, 1, 1, 1, 0), "M": (1, 4, 1, 1, 1, 0), "B": (5, 25, 0.7, 1, 0, 0), "N": (3, 14, 0, 0.3, 0, 0), "C": (10, 200, 0, 0.3, 1, 0), "R": (2, 5, 1, 1, 1, 0), "F": (2, 12, 0, 0.5, 0, 0), "K": (2, 9, 0, 0.3, 0, 0),
}


def labelled(seed: int, pages: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A labelled table: the FEATURES of blocks, and 1 for main text, 0 for the rest.

    It has `pages` pages of each layout, thrice as many of those whose figures alone must tell.
    """
    rng = np.random.default_rng(seed)
    x: list[list[float]] = []
    y: list[int] = []
    for layout in [x for x in LAYOUTS for _ in range(pages * (1 if x[0] == "a" else 3))]:
        kind, *parts = layout.split(":")
        found: list[Block] = []
        for at, part in enumerate(parts):
            mark = 0
            for letter in part:
                if letter in ".,":
                    mark = 2 * (letter == ",")
                    continue
                low, high, few, many, paragraph, heading = BLOCKS[letter]
                words = round(float(np.exp(rng.uniform(np.log(low), np.log(high)))))
                main = at == 1 and letter != "F"
                found.append(Block("", words, float(rng.uniform(few, many)), 1 if at == 1 and letter in "QF" else mark, kind == "a" and at == 1, bool(paragraph), bool(heading)))
                y.append(int(main))
        x += features(found, kind == "a")
    return np.array(x), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 8) -> tuple | bool:
    """A decision tree: (feature, bound, tree for values up to the bound, tree for the others), or a leaf's class."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    gini = lambda p, n: n * 2 * p * (1 - p)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            if min(low.sum(), (~low).sum()) < leaf:
                continue
            cost = gini(y[low].mean(), low.sum()) + gini(y[~low].mean(), (~low).sum())
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), low)
    if best is None or best[0] >= gini(share, len(y)) - 1e-12:
        return bool(share >= 0.5)
    _, f, bound, low = best
    return f, bound, grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)


def prune(node: tuple | bool, x: np.ndarray, y: np.ndarray) -> tuple | bool:
    """The tree without the cuts that tell the rows of a second table no better than a leaf would."""
    if isinstance(node, bool):
        return node
    f, bound, low, high = node
    side = x[:, f] <= bound
    low, high = prune(low, x[side], y[side]), prune(high, x[~side], y[~side])
    if len(y) == 0:
        return (f, bound, low, high) if low != high else low
    wrong = sum(_keep((f, bound, low, high), r) != bool(t) for r, t in zip(x.tolist(), y, strict=True))
    leaf = bool(y.mean() >= 0.5)
    return leaf if (y != leaf).sum() <= wrong else (f, bound, low, high)


@lru_cache(1)
def tree() -> tuple | bool:
    return prune(grow(*labelled(1)), *labelled(2))


def _keep(node: tuple | bool, row: list[float]) -> bool:
    while not isinstance(node, bool):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None, grown: tuple | bool | None = None) -> str:
    """The main text of one page."""
    found, has_main = blocks(page or "")
    grown = tree() if grown is None else grown
    return "\n\n".join(b.text for b, row in zip(found, features(found, has_main), strict=True) if _keep(grown, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    kind, grown = pages.schema[id_col].dataType.simpleString(), tree()  # grown here, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), grown) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
