"""Packs documents into sequences of bounded length: dominance reduction, then best fit on what remains.

Documents become token ids, closed by an end id; longer ones are cut into full pieces and a last one. Only the
number of pieces of each length (at most `capacity` numbers, whatever the input) goes to the driver, which plans
there; a plan is a list of runs "the pieces of this length from this rank on lie in these sequences at this
offset". Ranks within a length come from counts by (length, bucket), so no task sees all pieces of a length.

Planning follows Martello and Toth. A set of pieces F that holds piece j dominates every other feasible set with
j if each of those can be split into parts, one for each piece of F, none larger than its piece; F can then be
fixed as a sequence without loss. Three cases are used, each until none applies: {j} where j fits with no other
piece; {j, k} where k fills the sequence exactly; {j, k} where k is the largest sum that any pieces reach beside
j. All copies of such a pair are fixed at once. The rest is packed best fit, longest pieces first.

Defined results: null or empty text is the end id alone; repeated rows are packed each by itself; a null doc_id
is carried through; an empty table gives no rows. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import frugal, materialize, tasks, text_or_empty

CAPACITY = 2048
_CHUNK = 16 << 20  # bytes of text whose words are encoded together
#: Closing punctuation; special tokens may end in `>`, and parts may begin with an apostrophe.
_TAIL = ".,;:!?#$%*&@^~+=/-_)]}"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


class WordTokenizer:
    """Ids of whole texts as little-endian uint32, put together from the ids of their words.

    Only for tokenizers whose tokens never span white space, drop it, fold case, part letters from the rest, and mark
    the last token of a part by `</w>`. The different words of some texts are encoded once, those of letters in long
    lines, which cost less than a call for each; nothing is remembered from one call to the next.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        vocab = self.of.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for lo in range(0, len(texts), 10_000) for e in self.of.encode_batch_fast(texts[lo : lo + 10_000], add_special_tokens=False)]

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words that are one part each."""
        lengths, ids = [], []
        for lo in range(0, len(words), 5_000):
            some = words[lo : lo + 5_000].to_pylist()
            (found,) = self._alone([" ".join(some)])
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(found):
                each = self._alone(some)
                cuts, found = np.cumsum([len(x) for x in each]), _joined(each)
            lengths.append(np.diff(cuts, prepend=0))
            ids.append(found)
        return _joined(lengths), _joined(ids)

    def _words(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word: letters and the punctuation behind them apart, all others as they are."""
        found = pc.utf8_rtrim(words, characters=_TAIL).dictionary_encode()
        cores, core = found.dictionary, found.indices.to_numpy()
        letters = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False)
        line = " ".join(cores.filter(pa.array(letters)).to_pylist())
        if not _foldable(line.replace(" ", "")):
            letters = np.array([x and _foldable(w) for x, w in zip(letters, cores.to_pylist(), strict=True)], bool)
        apart = letters[core]
        size = pc.binary_length(cores).to_numpy()[core]
        more = apart & (pc.binary_length(words).to_numpy() > size)
        tails = pa.array([w[n:] for w, n in zip(words.cast(pa.binary()).filter(pa.array(more)).to_pylist(), size[more].tolist(), strict=True)], pa.binary()).dictionary_encode()
        others = self._alone([t.decode() for t in tails.dictionary.to_pylist()] + words.filter(pa.array(~apart)).to_pylist())
        lengths, ids = self._letters(cores.filter(pa.array(letters)))
        count, n_tails = len(lengths), len(tails.dictionary)
        parts = _lists(np.concatenate([lengths, [len(x) for x in others], [0]]), _joined([ids, *others]))
        at = np.full((len(words), 2), len(parts) - 1)  # two parts a word, the second one mostly the empty last
        at[apart, 0] = (np.cumsum(letters) - 1)[core[apart]]
        at[more, 1] = count + tails.indices.to_numpy()
        at[~apart, 0] = count + n_tails + np.arange(len(words) - np.count_nonzero(apart))
        taken = parts.take(pa.array(at.ravel()))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[::2]), taken.values)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin and the last ones end; the ids of all texts."""
        # Special tokens keep their case, and so do letters that a mark may compose with before they are folded.
        kept = pc.match_substring_regex(texts, r"<\||[\x{300}-\x{37f}]")
        words = pc.ascii_split_whitespace(pc.if_else(kept, texts, pc.ascii_lower(texts)))
        each, first = words.values.dictionary_encode(), words.offsets.to_numpy()
        del words  # as large as the texts
        ids = self._words(each.dictionary).take(each.indices)
        return ids.offsets.to_numpy()[first], ids.values.to_numpy()

    def encode(self, texts: list[str]) -> list[bytes]:
        at, ids = self.tokens(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))
        return [ids[lo:hi].tobytes() for lo, hi in pairwise(at.tolist())]


def _foldable(letters: str) -> bool:
    """Whether letters are normalised, and folding leaves them letters."""
    return unicodedata.is_normalized("NFC", letters) and (not letters or letters.lower().isalpha())


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as token pieces of at most `capacity` ids."""
    path, end = path or vocabulary(), int(end_id).to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(path)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            rows: list[tuple[int, int, int, int, int]] = []
            chunk = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1) // _CHUNK
            lo = 0
            while lo < len(texts):
                hi = int(np.searchsorted(chunk, chunk[lo], "right"))
                places, some = tok.tokens(texts[lo:hi])
                for at, (begin, stop) in enumerate(pairwise(places.tolist()), lo):
                    raw = some[begin:stop].tobytes() + end
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        rows.append((at, k, start // 4, len(part) // 4, zlib.crc32(part)))
                del some
                lo = hi
            if rows:
                at, k, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Runs of (length, first rank, pieces, first sequence, pieces in each sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.sequences = dict(counts), capacity, 0
        self.used = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        if n:
            self.runs.append((length, self.used[length], n, first, each, offset))
            self.used[length] += n
            self.left[length] -= n

    def fix(self, j: int, k: int | None, n: int) -> None:
        first = self.sequences
        self.sequences += n
        if k is None:
            self.put(j, n, first, 1, 0)
        elif k == j:
            self.put(j, 2 * n, first, 2, 0)
        else:
            self.put(j, n, first, 1, 0)
            self.put(k, n, first, 1, j)

    def largest_sum(self, room: int, without: int) -> int:
        """The largest sum up to room of any pieces left besides one of length `without`."""
        reach = 1
        full = (1 << (room + 1)) - 1
        for s, n in self.left.items():
            n = min(n - (s == without), room // s)
            step = 1
            while n > 0:  # powers of two make every multiple up to n
                step = min(step, n)
                reach |= (reach << (s * step)) & full
                n -= step
                step *= 2
            if reach >> room & 1:
                return room
        return reach.bit_length() - 1

    def reduce(self) -> None:
        """Fixes dominating sets until none is found."""
        changed = True
        while changed:
            changed = False
            for j in sorted((s for s, n in self.left.items() if n), reverse=True):
                while n := self.left[j]:
                    room = self.capacity - j
                    others = [s for s, m in self.left.items() if m - (s == j) > 0 and s <= room]
                    if not others:
                        self.fix(j, None, n if 2 * j > self.capacity else 1)
                        changed = True
                        continue
                    k = max(others)
                    if j + k != self.capacity and self.largest_sum(room, j) > k:
                        break
                    self.fix(j, k, n // 2 if k == j else min(n, self.left[k]))
                    changed = True

    def best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
        rooms = 0  # a bit for each key of open_

        def keep(room: int, first: int, number: int) -> None:
            nonlocal rooms
            if number and room:
                open_.setdefault(room, []).append((first, number))
                rooms |= 1 << room

        for s in sorted((x for x, m in self.left.items() if m), reverse=True):
            while n := self.left[s]:
                fitting = rooms >> s
                if fitting:
                    room = s + (fitting & -fitting).bit_length() - 1
                    first, number = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms &= ~(1 << room)
                else:
                    room, each = self.capacity, self.capacity // s
                    first, number = self.sequences, -(-n // each)
                    self.sequences += number
                each = room // s
                full = min(number, n // each)
                self.put(s, full * each, first, each, self.capacity - room)
                keep(room - each * s, first, full)
                if full < number:
                    rest = n - full * each
                    if rest:
                        self.put(s, rest, first + full, rest, self.capacity - room)
                        keep(room - rest * s, first + full, 1)
                        full += 1
                    keep(room, first + full, number - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> tuple[np.ndarray, int]:
    """Runs for pieces counted by length, by length and rank, and the number of sequences."""
    p = _Plan({int(s): int(n) for s, n in counts.items() if n}, capacity)
    if reduce:
        p.reduce()
    p.best_fit()
    runs = np.array(sorted(p.runs), np.int64).reshape(-1, 6)
    return runs, p.sequences


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that no packing can do without (the bound L2 of Martello and Toth)."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        low = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        spare = sum((capacity - s) * n for s, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(low - spare) // capacity)))
    return best


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of docs with sequence_id and offset, gapless in each sequence."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, path, capacity, end_id), "pieces")
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(tasks(spark))))
    counted = materialize(made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(runs)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("length", "bucket", before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    # Both sides lie by length and bucket already; the offsets grow with the buckets, so they are not broadcast.
    ranked = made.withColumn("rank", F.row_number().over(order) - 1).join(offsets.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 44) | table[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            run = table[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            within = rank - run[:, 1]
            sequence = run[:, 3] + within // run[:, 4]
            offset = run[:, 5] + within % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(frugal(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
