"""A training mixture: sources meet target weights, and a curriculum says when each document comes.

All in DataFrame functions. Sizes are words. Sources, in order of code points and null last, take the weights in turn and
share the mixture's words (100 percent of all sizes) by weight; a target stops at `epochs` times its source's size, and
the excess is shared again by weight until none is above. That runs on whole numbers over one row a source, a round for
each time that targets stop, so no task sees all sources and the driver sees one row of sums.

The curriculum gives each weight a schedule: factors at equally spaced times of training, linear in between. Their integral
is a source's cumulative demand for words, scaled to its target. A source's documents follow each other in an order of
hashes, again and again, as far as the target goes; a document that begins behind x words has the time at which the
cumulative demand reaches x (the integral inverted: a piece is a parabola) as its position. The last document that is
taken is taken in part, so a source gives its target to the word. schedule() sorts all places by range of position.

What comes before a document is summed in two steps, by bucket of hashes and within one, so that a source of any size
is spread; a bucket holds 1/4096 of a source's documents. Reruns agree, whatever the partitions.

Defined results: null and empty texts have no words, take nothing and are rows all the same; a null source is the last
source; a null doc_id counts as the empty text in the hash; rows that share an id are taken each, the smaller first; a
source without words, as a table without them, has the target 0; an empty table gives no rows. Columns besides doc_id,
source and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import materialize, numbered, text_or_empty

WEIGHTS, EPOCHS = (1, 2, 3), 3
#: weight -> factors of its schedule: light sources come early, heavy ones late.
CURRICULUM = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.25, 1.0), 3: (0.5, 1.0, 1.5)}
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """The number of runs of anything but white space; memory follows the text's length, not its number of words."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.octet_length(F.translate(marks, _SPACE, "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """key, source_size, weight, target, budget (the target in whole words) of sizes (key, source_size), one row a source."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    left = numbered(sizes.select("key", "source_size", F.lit(0).alias("all")), ["all"], ["key"], "i", "n").select("key", "source_size", turn.alias("weight"))
    whole = left.agg(F.sum("source_size"), F.sum("weight")).first()
    words_left, weight_left, full = whole[0] or 0, whole[1] or 0, None
    wide = lambda c: c.cast("decimal(38,0)")
    cap = F.col("source_size") * epochs
    while True:
        share = wide(F.lit(words_left)) * wide(F.col("weight"))
        stops = left.where(share > wide(cap) * wide(F.lit(weight_left)))
        sums = stops.agg(F.sum(cap), F.sum("weight")).first()
        if not sums[1]:
            break
        full = stops if full is None else full.unionByName(stops)
        left = left.where(~(share > wide(cap) * wide(F.lit(weight_left))))
        words_left, weight_left = words_left - sums[0], weight_left - sums[1]
    own = ["key", "source_size", "weight"]
    shared = F.lit(words_left).cast("double") * F.col("weight") / F.lit(max(weight_left, 1))
    out = left.select(*own, shared.alias("target"))
    if full is not None:
        out = out.unionByName(full.select(*own, cap.cast("double").alias("target")))
    return out.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), cap))


def _reached(share: Column, weight: Column, curriculum: dict[int, tuple[float, ...]]) -> Column:
    """The time (0 to 1) at which a weight's cumulative demand reaches a share of all it ever asks for."""
    out = F.lit(None).cast("double")
    for w, factors in curriculum.items():
        step, at, pieces = 1.0 / (len(factors) - 1), 0.0, []
        whole = sum((a + b) * step / 2 for a, b in zip(factors, factors[1:], strict=False))
        for j, (a, b) in enumerate(zip(factors, factors[1:], strict=False)):
            a, b = a / whole, b / whole
            beyond = share - F.lit(at)
            root = F.sqrt(F.lit(a * a) + beyond * F.lit(2 * (b - a) / step))
            at += (a + b) * step / 2
            pieces.append((at, F.lit(j * step) + F.coalesce(F.try_divide(beyond * 2, F.lit(a) + root), F.lit(0.0))))
        found = pieces[-1][1]
        for end, time in reversed(pieces[:-1]):
            found = F.when(share < end, time).otherwise(found)
        out = F.when(weight == w, found).otherwise(out)
    return out


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, curriculum: dict[int, tuple[float, ...]] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, taken and copies of every row of docs.

    copies: an array of struct(position, copy, words) of the times that the document is taken, at most `epochs`. The
    curriculum needs a schedule for each weight.
    """
    source = F.col("source").cast("string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", source.alias("source"), F.when(source.isNull(), "t").otherwise(F.concat(F.lit("s"), source)).alias("key"), digest.alias("h"), words(text_or_empty()).alias("size"))
    rows = materialize(rows.withColumn("bucket", F.substring("h", 1, 3)), "sizes")
    sums = materialize(rows.groupBy("key", "bucket").agg(F.sum("size").alias("sum")), "buckets")
    wanted = targets(sums.groupBy("key").agg(F.sum("sum").alias("source_size")), weights, epochs)
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("key", "bucket", ahead(Window.partitionBy("key").orderBy("bucket"), "sum").alias("bucket_at")).join(wanted, "key")
    placed = rows.withColumn("at", ahead(Window.partitionBy("key", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size"), "size")).join(before, ["key", "bucket"])

    def copy(e: Column) -> Column:
        start = e * F.col("source_size") + F.col("bucket_at") + F.col("at")
        taken = F.least(F.greatest(F.col("budget") - start, F.lit(0)), F.col("size"))
        return F.struct(_reached(F.try_divide(start, F.col("target")), F.col("weight"), curriculum or CURRICULUM).alias("position"), e.alias("copy"), taken.alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), copy), lambda x: x["words"] > 0)
    out = placed.select("doc_id", "source", "size", "source_size", "weight", "target", copies.alias("copies"))
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda n, x: n + x["words"]))


def schedule(mixed: DataFrame) -> DataFrame:
    """doc_id, source, copy, words, position: what training reads, in its order, sorted by range over all partitions."""
    each = materialize(mixed.select("doc_id", "source", F.explode("copies").alias("x")).select("doc_id", "source", "x.*"), "copies")
    return each.orderBy("position", "source", "doc_id", "copy")


def by_position(mixed: DataFrame) -> DataFrame:
    """mixed in the order of documents' first positions (those that are not taken last), with that position."""
    first = materialize(mixed.withColumn("position", F.try_element_at("copies", F.lit(1))["position"]), "mixed")
    return first.orderBy(F.col("position").asc_nulls_last(), "source", "doc_id")
