"""Fill-in-middle: a text becomes prefix, suffix and middle with sentinels, cut at token boundaries.

Tokens are runs of ASCII letters, and every other code point by itself. The cuts depend on the number of tokens, which is
known only once a text is counted. So counting keeps a sparse index: every `step` tokens the byte and the code point at
which the next one begins. A cut is then found by binary search among these checkpoints and a short rescan from the
one before it; no list of tokens is ever kept. Texts are scanned in blocks of bytes.

Where a text is cut and in which form it is written follows from (seed, doc_id) alone: the four first 32-bit groups of
sha256("seed:doc_id") give the two cuts (modulo n + 1), whether there is a transformation (third below `rate` percent)
and which (fourth below `spm` percent: suffix first). Forms: plain (the text), psm (prefix, suffix, middle), spm (suffix,
prefix, middle). A text that holds a sentinel stays plain, so restore() always gives it back exactly.

Defined results: null and empty texts are empty and plain, with no tokens; a null doc_id counts as the empty text in the
hash; repeated rows are written each; a text of any length is cut whole; an empty table gives no rows. Columns besides
the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.llm.common import text_or_empty

#: What stands before prefix, suffix and middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
STEP, _BLOCK, _FLUSH = 256, 1 << 20, 1 << 24


def _begins(data: np.ndarray, before: int) -> np.ndarray:
    """Whether a token begins at each byte of UTF-8; before is the byte that precedes them (-1 at a text's start)."""
    letter = ((data | 32) - np.uint8(97)) < 26
    inside = np.empty(len(data), bool)
    inside[0] = before >= 0 and 97 <= before | 32 <= 122
    inside[1:] = letter[:-1]
    return np.where(letter, ~inside, (data & 0xC0) != 0x80)


class Checkpoints:
    """The number of tokens of a UTF-8 text, and the byte and code point at which every step-th token begins."""

    def __init__(self, data: bytes, step: int = STEP):
        self.data, self.n, self.points = np.frombuffer(data, np.uint8), 0, 0
        tokens, places, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for low in range(0, len(self.data), _BLOCK):
            part = self.data[low : low + _BLOCK]
            at = np.flatnonzero(_begins(part, int(self.data[low - 1]) if low else -1))
            first = np.flatnonzero((part & 0xC0) != 0x80)
            chosen = np.arange(-self.n % step or (0 if self.n else step), len(at), step)
            tokens.append(self.n + chosen)
            places.append(low + at[chosen])
            points.append(self.points + np.searchsorted(first, at[chosen]))
            self.n, self.points = self.n + len(at), self.points + len(first)
        self._tokens, self._places, self._points = map(np.concatenate, (tokens, places, points))

    def locate(self, cut: int) -> tuple[int, int]:
        """The byte and the code point behind the first `cut` tokens."""
        if cut >= self.n:
            return len(self.data), self.points
        k = int(np.searchsorted(self._tokens, cut, "right")) - 1
        low = int(self._places[k])
        high = int(self._places[k + 1]) if k + 1 < len(self._places) else len(self.data)
        part = self.data[low:high]
        at = int(np.flatnonzero(_begins(part, -1))[cut - int(self._tokens[k])])
        return low + at, int(self._points[k]) + int(np.count_nonzero((part[:at] & 0xC0) != 0x80))


def write(doc_id: int | None, data: bytes, seed: int = 1, rate: int = 90, spm: int = 20, step: int = STEP) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle (None if plain), and the output of one text in UTF-8."""
    index = Checkpoints(data, step)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    a, b, how, which = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not data or how % 100 >= rate or any(s in data for s in SENTINELS):
        return index.n, "plain", None, None, data
    (low, p), (high, q) = (index.locate(c) for c in sorted((a % (index.n + 1), b % (index.n + 1))))
    before, after, between = SENTINELS
    if which % 100 < spm:
        return index.n, "spm", p, q - p, b"".join((after, data[high:], before, data[:low], between, data[low:high]))
    return index.n, "psm", p, q - p, b"".join((before, data[:low], after, data[high:], between, data[low:high]))


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for b in batches:
            ids, texts, rows, first, size = b.column(0), b.column(1).cast(pa.large_binary()), [], 0, 0
            for k in range(len(b)):
                rows.append(write(ids[k].as_py(), texts[k].as_py(), seed, rate, spm))
                size += len(rows[-1][-1])
                if size >= _FLUSH or k + 1 == len(b):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *columns], names=["doc_id", *kind.names])
                    rows, first, size = [], k + 1, 0

    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that output was made of."""
    before, after, between = (s.decode() for s in SENTINELS)

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        """What stands behind the first sentinel, the second and the last, each to the next one."""
        body = F.substr(output, F.lit(len(one) + 1))
        first = F.substring_index(body, two, 1)
        rest = F.substr(body, F.char_length(first) + len(two) + 1)
        second = F.substring_index(rest, between, 1)
        return first, second, F.substr(rest, F.char_length(second) + len(between) + 1)

    prefix, suffix, middle = parts(before, after)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(after, before)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
