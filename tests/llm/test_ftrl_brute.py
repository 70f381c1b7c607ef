"""Toxicity's features and trainer against a restatement with dictionaries, one coordinate at a time."""

import math

import numpy as np
import xxhash

from sparkwake.llm import toxicity
from sparkwake.llm.common import MASK, mix


def named(text, bits):
    """The features of a text by their definition."""
    mask, out = (1 << bits) - 1, set()
    words = text.lower().encode("utf-8", "replace").translate(toxicity._BREAKS).split()
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    for w, h in zip(words, hashes, strict=True):
        out.add(h & mask)
        u = w.decode()
        for n in (3, 4, 5, 6):
            out.add(xxhash.xxh3_64_intdigest(u[:n].encode(), n) & mask if len(u) >= n else h & mask)
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        for a, b in zip(hashes, hashes[gap:], strict=False):
            out.add(int(mix(np.array([(a * salt + b) & MASK], np.uint64))[0]) & mask)
    return out


def trained(examples, s):
    """FTRL-proximal by its formulas."""
    z, n, z0, n0 = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    rng = np.random.default_rng(7)
    for _ in range(max(2, min(s.max_epochs, -(-s.min_examples // len(examples))))):
        for k in rng.permutation(len(examples)):
            features, y = examples[k]
            w = {i: weight(i) for i in features}
            bias = -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + bias)))) - y
            for i in features:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / s.alpha * w[i]
                n[i] = was + g * g
            z0, n0 = z0 + g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / s.alpha * bias, n0 + g * g
    return {i: weight(i) for i in z if weight(i)}, -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)


TEXTS = ["", "one", "You are a fool, a FOOL!", "a perfectly fine day in the park", "Straße und Übermut; straße", "汉字 words 汉字", "x " * 50, "fool " * 3 + "park"] + [f"word{k} {'bad' if k % 3 == 0 else 'good'} thing number {k} here" for k in range(40)]


def test_features():
    make = toxicity.Features(12, keep=30)
    doc, feature = make.pairs(TEXTS)
    got = [set(feature[doc == k].tolist()) for k in range(len(TEXTS))]
    assert got == [named(t, 12) for t in TEXTS]


def test_trainer():
    s = toxicity.Settings(bits=12, l1=0.5, min_examples=120)
    sets = [np.array(sorted(named(t, 12)), np.uint32) for t in TEXTS]
    marks = [int("bad" in t or "fool" in t.lower()) for t in TEXTS]
    model = toxicity.ftrl(list(zip(sets, marks, strict=True)), s)
    weights, bias = trained([(x.tolist(), y) for x, y in zip(sets, marks, strict=True)], s)
    assert set(model.index.tolist()) == set(weights) and weights
    assert abs(model.bias - bias) < 1e-9
    assert all(abs(w - weights[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight.tolist(), strict=True))
