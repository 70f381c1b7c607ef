"""License scans against a plain loop over windows and templates."""

import random

from sparkwake.llm import licenses

NOTICES = [(name, licenses.words_of(x)) for name, xs in licenses.TEMPLATES.items() for x in xs]


def held(words, notice):
    """The most of a notice's shingles, in 100, that any run of one and a half of its length holds."""
    need, n, best = set(licenses.shingles_of(notice)), -(-len(notice) * 3 // 2), 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    for i in range(max(1, len(sh) - n + 4)):
        best = max(best, len(need & set(sh[i : i + n - 2])))
    return 100 * best / len(need)


def test_against_a_loop(spark):
    """What a window of a notice's own length holds is found; nothing is found that no longer window holds."""
    rng, filler, texts = random.Random(9), "the of and report on work with this file is used for any license software under version free".split(), []
    for k in range(150):
        out = [rng.choice(filler) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            name, notice = rng.choice(NOTICES)
            words = list(notice)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"x{k}"
            out += words + [rng.choice(filler) for _ in range(rng.randrange(30))]
        texts.append(" ".join(out))
    rows = {r.doc_id: set(r.licenses) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    some = 0
    for i, t in enumerate(texts):
        words = licenses.words_of(t)
        most = {}
        for name, notice in NOTICES:
            most[name] = max(most.get(name, 0), held(words, notice))
        sure = {name for name, p in most.items() if p >= 75}
        assert rows[i] <= sure, (i, rows[i], sure)
        # of notices that lie in each other the fuller one stays
        assert all(name in rows[i] or any(most[x] >= most[name] for x in rows[i]) for name in sure), (i, rows[i], sure)
        some += bool(rows[i])
    assert some > 60
