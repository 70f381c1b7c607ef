"""Secret scans: strong patterns by themselves, weak ones where complementary parts of a credential meet.

All in DataFrame functions. Base kinds stand by themselves:

* assign: a keyword, `:` or `=`, and a value of 12 or more characters;
* access: AKIA and capitals or digits, 18 or more characters in all;
* hex: 16 or more lower-case hexadecimal digits.

Multipart linking adds kinds that say little alone: `id` (an identifier of an account, user or client given by
name, or a short AKIA word), `key` (a password, secret, token or key given with a value of 6 to 11 characters, or
a bare run of 32 or more base64 characters that has a digit, a capital and a small letter) and `host` (a URL or a
host given by name). Every span plays a role: access and id are identifiers, assign, hex and key are secrets, host
is an endpoint. A scope is the `reach` characters around a span within one text. A weak span is reported if its
scope has a complementary part: for an id a secret, for a key an identifier or an endpoint, for a host both an
identifier and a secret. This interval join is a range frame over each text's spans in order of place, so it costs
no pairs however many spans a text has.

Spans count code points, end exclusive. Matches are the leftmost ones, not overlapping, of each kind's pattern
without its length; those too short are dropped after matching. They are found by splitting the text at the
matches: the pieces between give the places.

Long arrays are folded in groups, so a text with very many spans costs little more for each of them. Patterns look no
further than the run that they begin in, so a text without any space costs as much as one with spaces. Spans depend on
a row's text alone: only rows with a weak span take part in a join, and only spans are shuffled for it but for the
texts of those rows when they are masked.

Defined results: a null text is empty (and stays null when masked); a text without spans has zero counts, the SHA-256
of the empty text and an empty `spans`; rows with the same doc_id and text get the same result each; a null doc_id is
carried through; an empty table gives no rows. Columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import fresh, materialize, text_or_empty

KINDS = ("assign", "access", "hex", "id", "key", "host")
_VALUE = "[A-Za-z0-9+/_.=-]"
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> pattern, least length, and the group whose length counts. A maximal run that is too short holds no
#: longer match, so the length may stand in the pattern of `access` and `hex`; for `assign` it may not.
PATTERNS = {
    "assign": (rf"(?:(?i:password|passwd|secret|token|api_?key)){_GIVEN}({_VALUE}+)", 12, 1),
    "access": (r"AKIA[A-Z0-9]{14,}", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),
}
WEAK = {
    "id": rf"(?i:access_?key_?id|client_?id|account_?id|user_?name|login){_GIVEN}[A-Za-z0-9_.@-]{{3,}}|AKIA[A-Z0-9]{{8,13}}(?![A-Z0-9])",
    "key": rf"(?i:password|passwd|secret|token|api_?key){_GIVEN}{_VALUE}{{6,11}}(?!{_VALUE})|(?<!{_VALUE})(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{{32,}}={{0,2}}",
    "host": r"""(?i:https?|ftp|ssh|s3|jdbc:[a-z]+)://[^\s<>"']+|(?i:host|endpoint|server|hostname)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]+)?""",
}
#: A text needs one of these for its kinds to be looked for; each pattern contains its own.
_HINTS = {
    "assign": r"(?i:pass(?:word|wd)|secret|token|api_?key)",
    "access": "AKIA",
    "hex": r"[0-9a-f]{16}",
}


_GROUP = 1000  # of an array that is folded at once
_NONE = "array<struct<start:int,k:int,stop:int>>"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _folded(items: Column, start: Column, total, further, step) -> Column:
    """Items in order, folded group by group into one array.

    total(group) sums a group up, further(state, sum) gives the state behind it, and step(state, item) the state behind
    an item and what it adds to the array, as struct(state, made).
    """

    def groups(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(_GROUP)), lambda i: F.slice(all_, i + 1, _GROUP))

    def states(parts: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(F.transform(parts, total), zero, lambda acc, x: F.struct(further(acc["at"], x).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list")), lambda acc: acc["list"])

    def one(group: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(_NONE).alias("made"))
        return F.aggregate(group, zero, lambda acc, x: _let(step(acc["at"], x), lambda y: F.struct(y["state"].alias("at"), F.concat(acc["made"], y["made"]).alias("made"))), lambda acc: acc["made"])

    return _let(items, lambda all_: _let(groups(all_), lambda parts: F.flatten(F.zip_with(parts, states(parts), one))))


def places(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Array of struct(start, kind's number, stop) of the leftmost matches that do not overlap, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if least and group else F.transform(found, F.char_length)
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    parts = F.arrays_zip(between.alias("gap"), F.transform(found, F.char_length).alias("len"), sized.alias("size"))
    width = lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))

    def step(at: Column, x: Column) -> Column:
        one = F.array(F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("k"), (at + width(x)).alias("stop")))
        long_enough = x["len"].isNotNull() & (F.coalesce(x["size"], F.lit(0)) >= least)
        return F.struct((at + width(x)).alias("state"), F.when(long_enough, one).otherwise(_empty()).alias("made"))

    return _folded(parts, F.lit(0), lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + width(x)), lambda at, x: at + x, step)


def _empty() -> Column:
    return F.array().cast(_NONE)


def _names(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, reach: int = 400, columns: tuple[str, ...] = ("doc_id",), base: str = "base", linked: str = "linked") -> DataFrame:
    """Columns of docs, base and linked spans (arrays of struct(start, k, stop); k numbers KINDS) of every row of docs."""
    text = text_or_empty()
    strong = F.concat(*[F.when(text.rlike(_HINTS[kind]), places(text, pattern, kind, least, group)).otherwise(_empty()) for kind, (pattern, least, group) in PATTERNS.items()])
    weak = F.concat(*[F.when(text.rlike(pattern), places(text, pattern, kind)).otherwise(_empty()) for kind, pattern in WEAK.items()])
    part, key = fresh(docs.withColumns({base: F.lit(0), linked: F.lit(0)}), "weak", "text_key")
    found = docs.select(*columns, *(() if "text" in columns else ("text",)), strong.alias(base), weak.alias(part))
    found = found.withColumn(key, F.when(F.size(part) > 0, F.sha2(text, 256)))
    rows = materialize(found.select(*columns, base, part, key), "spans")
    none, some = rows.where(F.col(key).isNull()), rows.where(F.col(key).isNotNull())
    told = _linked(some.select(F.col(key).alias("text_key"), F.col(base).alias("base"), F.col(part).alias("weak")), reach).toDF(key, linked)
    some = some.join(told, key, "left").select(*columns, base, F.coalesce(linked, _empty()).alias(linked))
    return none.select(*columns, base, _empty().alias(linked)).unionByName(some)


def _linked(rows: DataFrame, reach: int) -> DataFrame:
    """text_key, linked: the weak spans of each text (text_key, base, weak) that a complementary part lies near."""
    parts = rows.dropDuplicates(["text_key"]).select("text_key", F.explode(F.concat("base", "weak")).alias("s")).select("text_key", "s.*")
    # A weak span that overlaps a base one is part of it.
    strong, first = F.col("k") < len(PATTERNS), Window.unboundedPreceding
    from_start, from_end = (Window.partitionBy("text_key").orderBy(x) for x in (F.col("start"), F.col("start").desc()))
    parts = parts.withColumn("before", F.max(F.when(strong, F.col("stop"))).over(from_start.rangeBetween(first, 0))).withColumn("after", F.min(F.when(strong, F.col("start"))).over(from_end.rangeBetween(first, -1)))
    parts = parts.where(strong | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))))
    role = F.when(F.col("k").isin(1, 3), "id").when(F.col("k").isin(0, 2, 4), "key").otherwise("host")
    scope = from_start.rangeBetween(-reach, reach)
    seen = parts.select("*", *(F.sum((role == x).cast("int")).over(scope).alias(f"n_{x}") for x in ("id", "key", "host")))
    linked = ((F.col("k") == 3) & (F.col("n_key") > 0)) | ((F.col("k") == 4) & (F.col("n_id") + F.col("n_host") > 0)) | ((F.col("k") == 5) & (F.col("n_id") > 0) & (F.col("n_key") > 0))
    return seen.where(linked).groupBy("text_key").agg(F.collect_list(F.struct("start", "k", "stop")).alias("linked"))


def secret_spans(docs: DataFrame, reach: int = 400) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, for every row of docs."""
    found = scan(docs, reach)
    count = lambda kind: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(F.concat("base", "linked")).alias("spans"))


_PIECE = 4096  # characters


def _without(text: Column, spans: Column, mask: str) -> Column:
    """text with each span, or spans that overlap, replaced by mask."""

    def step(at: Column, x: Column) -> Column:
        gap = F.array(F.struct(at.alias("start"), F.lit(0).alias("k"), x["start"].alias("stop")))
        return F.struct(F.greatest(at, x["stop"]).alias("state"), F.when(x["start"] >= at, gap).otherwise(_empty()).alias("made"))

    gaps = _folded(F.array_sort(spans), F.lit(0), lambda g: F.array_max(F.transform(g, lambda x: x["stop"])), F.greatest, step)
    # The text in pieces of equal length, so that no place is counted from the start of a long text again and again.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def between(all_: Column, x: Column) -> Column:
        a, b = (F.floor(x[k] / _PIECE).cast("int") for k in ("start", "stop"))
        at = x["start"] % _PIECE + 1
        within = F.substring(F.get(all_, a), at, x["stop"] - x["start"])
        across = F.concat(F.substring(F.get(all_, a), at, F.lit(_PIECE)), F.array_join(F.slice(all_, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(all_, b), F.lit(1), x["stop"] % _PIECE), F.lit("")))
        return F.coalesce(F.when(a == b, within).otherwise(across), F.lit(""))

    last = F.array(F.struct(F.array_max(F.transform(spans, lambda x: x["stop"])).alias("start"), F.lit(0).alias("k"), F.char_length(text).alias("stop")))
    return _let(pieces, lambda all_: F.array_join(F.transform(F.concat(gaps, last), lambda x: between(all_, x)), mask))


def redact(docs: DataFrame, reach: int = 400, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mask, all columns kept; overlapping spans become one mask."""
    base, linked = fresh(docs, "base", "linked")
    found = scan(docs, reach, tuple(docs.columns), base, linked)
    spans = F.concat(base, linked)
    text = F.when(F.size(spans) > 0, _without(F.col("text"), spans, mask)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
