"""Decoders, chains of them, and a search over chains; all on bytes, all bounded in output."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.text import entropy_of

MAX_OUTPUT = 16 << 20
_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])
#: By byte and key: 1 if the byte is printable under the key.
_UNDER = np.isin(np.arange(256)[:, None] ^ np.arange(256), list(_PRINTABLE)).astype(np.float32)
_BASE64, _BASE32, _HEX = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"0123456789abcdefABCDEF"
_ROT13 = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")
#: Outputs that leave a task together: rows and bytes; and up to how many bytes a value is looked up among those before.
_ROWS, _BYTES, _SHORT = 10_000, 4 << 20, 256
_GROUP = 256  # values of a batch that are held as Python objects at a time


def printable(data: bytes) -> bool:
    """Over 85 in 100 bytes are printable."""
    if len(data) < 1024:
        return bool(data) and (len(data) - len(data.translate(None, _PRINTABLE))) / len(data) > 0.85
    values = np.frombuffer(data, np.uint8)
    count = np.count_nonzero(values - np.uint8(32) < 95)
    return bool((count if count / len(data) > 0.85 else count + sum(np.count_nonzero(values == x) for x in (9, 10, 13))) / len(data) > 0.85)


def _only(text: bytes, letters: bytes) -> bool:
    return not text[:64].translate(None, letters) and not text.translate(None, letters)


def un_base64(data: bytes, short: bool = False) -> bytes | None:
    """short: nothing decodes to nothing; else it isn't taken for base64."""
    text = data.strip()
    if len(text) < 4 or len(text) % 4:
        return b"" if short and not text else None
    body = text.rstrip(b"=")
    if not body or len(text) - len(body) > 2 or body[:64].translate(None, _BASE64):
        return None
    try:
        return binascii.a2b_base64(text, strict_mode=True) or None
    except binascii.Error:
        return None


def un_base32(data: bytes) -> bytes | None:
    text = data.strip().rstrip(b"=")
    if len(text) < 8 or not _only(text, _BASE32):
        return None
    try:
        return base64.b32decode(text + b"=" * (-len(text) % 8)) or None
    except binascii.Error:
        return None


def un_hex(data: bytes, short: bool = False) -> bytes | None:
    """short: less than four digits, or none, are taken too."""
    if not _only(data[:64], _HEX + b" \t\n\r\x0b\f"):
        return None
    text = data.translate(None, b" \t\n\r\x0b\f")
    try:
        return binascii.unhexlify(text) if (short or len(text) >= 4) and len(text) % 2 == 0 else None
    except binascii.Error:
        return None


def un_url(data: bytes) -> bytes | None:
    out = unquote_to_bytes(data)
    try:
        out.decode()
    except UnicodeDecodeError:
        return None
    return out if out != data else None


def rot13(data: bytes) -> bytes:
    return data.translate(_ROT13)


def _inflate(data: bytes, bits: int, most: int) -> bytes | None:
    """What data unpacks to; None if it is broken, or more than `most` bytes."""
    try:
        unpacking = zlib.decompressobj(bits)
        out = unpacking.decompress(data, most)
        return None if unpacking.unconsumed_tail else out or None
    except zlib.error:
        return None


def un_gzip(data: bytes, most: int = MAX_OUTPUT) -> bytes | None:
    return _inflate(data, 31, most) if data[:2] == b"\x1f\x8b" else None


def un_zlib(data: bytes, most: int = MAX_OUTPUT) -> bytes | None:
    return _inflate(data, 15, most) if data[:1] == b"\x78" else None


def xor(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.uint8(key)).tobytes()


def xor_search(data: bytes, shown: bool | None = None) -> tuple[int, bytes] | None:
    """The first key that makes unprintable data of at most 4096 bytes printable; shown: whether data is, where known."""
    if not data or len(data) > 4096 or (printable(data) if shown is None else shown):
        return None
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32) @ _UNDER).astype(np.float64) / len(data)
    keys = np.flatnonzero(shares[1:] > 0.85)
    return (int(keys[0]) + 1, xor(data, int(keys[0]) + 1)) if len(keys) else None


STEPS = {"base64": un_base64, "base32": un_base32, "hex": un_hex, "url": un_url, "url_decode": un_url, "rot13": rot13, "gunzip": un_gzip, "gzip": un_gzip, "zlib": un_zlib}
_BOUNDED, _GUARDED = ("gunzip", "gzip", "zlib"), ("base64", "hex")


def _step(name: str, data: bytes, most: int, short: bool = False) -> bytes | None:
    return STEPS[name](data, most) if name in _BOUNDED else STEPS[name](data, short) if name in _GUARDED else STEPS[name](data)


def apply_chain(data: bytes, chain: str, most: int = MAX_OUTPUT, short: bool = False) -> bytes:
    """Decodes by steps parted by `|`: a name of STEPS or xor:KEY. Raises ValueError for unknown or failing steps.

    A step that unpacks to more than `most` bytes fails. Base64 and hex of less than four letters fail too, unless with
    short, for data that is known to be encoded.
    """
    for step in (x.strip() for x in chain.split("|")):
        if step.startswith("xor:"):
            out = xor(data, int(step[4:], 0) & 0xFF)
        elif step in STEPS:
            out = _step(step, data, most, short)
        else:
            raise ValueError(f"unknown step {step!r}")
        if out is None:
            raise ValueError(f"step {step!r} can't decode its input")
        data = out
    return data


def decodings(data: bytes, most: int = MAX_OUTPUT, shown: bool | None = None) -> list[tuple[str, bytes]]:
    """What each decoder makes of data, in a fixed order; shown: whether data is printable, where known."""
    shown = printable(data) if shown is None else shown
    out = [(n, x) for n in ("base64", "base32", "hex") if (x := STEPS[n](data))]
    if b"%" in data and (x := un_url(data)):
        out.append(("url", x))
    if shown and (x := rot13(data)) != data:
        out.append(("rot13", x))
    out += [(n, x) for n in ("gunzip", "zlib") if (x := _step(n, data, most))]
    if found := xor_search(data, shown):
        out.append((f"xor:0x{found[0]:02x}", found[1]))
    return out


def auto_decode(data: bytes, depth: int = 3, most: int = MAX_OUTPUT) -> list[tuple[list[str], bytes]]:
    """(chain, output) of every chain up to depth, each output once, longest chains first."""
    return [(c, o) for c, o, _ in _walked(data, depth, most)]


def _walked(data: bytes, depth: int, most: int) -> list[tuple[list[str], bytes, bool]]:
    """auto_decode with whether each output is printable, which is looked at once."""
    found: dict[bytes, tuple[list[str], bool]] = {}

    def walk(x: bytes, chain: list[str], shown: bool) -> None:
        if len(chain) == depth:
            return
        for name, out in decodings(x, most, shown):
            if chain and chain[-1] == name == "rot13" or out == data or out in found:
                continue
            found[out] = [*chain, name], printable(out)
            walk(out, *found[out])

    walk(data, [], printable(data))
    return sorted(((c, o, shown) for o, (c, shown) in found.items()), key=lambda x: -len(x[0]))


def _native(column, step: str, short: bool = False):
    """base64 and hex as built-in functions, with the guards of un_base64 and un_hex."""
    text = F.decode(column, "ISO-8859-1")
    if step == "base64":
        text = F.regexp_replace(text, r"^\s+|\s+$", "")
        fits = text.rlike("^(?:[A-Za-z0-9+/]+={0,2})?$" if short else "^[A-Za-z0-9+/]+={0,2}$") & (F.char_length(text) % 4 == 0)
        return F.when(fits, F.try_to_binary(text, F.lit("base64")))
    text = F.regexp_replace(text, r"\s", "")
    return F.when(text.rlike(f"^(?:[0-9a-fA-F]{{2}}){{{0 if short else 2},}}$"), F.unhex(text))


def _chained(values: pa.Array, steps: list[str], most: int, short: bool = False) -> pa.Array:
    """values by steps. Steps of XOR pass over the bytes of all values at once; else one value at a time is unpacked."""
    if values.type == pa.binary() and all(re.fullmatch("xor:(0|[1-9][0-9]*|0x[0-9a-fA-F]+)", x) for x in steps):
        key = 0
        for x in steps:
            key ^= int(x[4:], 0) & 0xFF
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
        body = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] ^ np.uint8(key)
        return pa.Array.from_buffers(pa.binary(), len(values), [pa.py_buffer(np.packbits(values.is_valid().to_numpy(zero_copy_only=False), bitorder="little")), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(body)])
    chain, out = "|".join(steps), []
    for lo in range(0, len(values), _GROUP):
        found = []
        for v in values[lo : lo + _GROUP]:
            try:
                found.append(apply_chain(v.as_py(), chain, most, short) if v.is_valid else None)
            except ValueError:
                found.append(None)
        out.append(pa.array(found, pa.binary()))
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def decoded(column, chain: str, most: int = MAX_OUTPUT, short: bool = False):
    """Column of bytes decoded by chain; null where a step fails, or unpacks to more than `most` bytes; short as in apply_chain."""
    steps = [x.strip() for x in chain.split("|")]
    if set(steps) <= {"base64", "hex"}:
        for step in steps:
            column = _native(column, step, short)
        return column

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return _chained(values, steps, most, short)

    return run(column)


@F.udtf(returnType="chain: array<string>, data: binary, printable: boolean")
class AutoDecode:
    """auto_decode(data, depth) as a table function."""

    def eval(self, data: bytes, depth: int):
        yield from _walked(bytes(data), depth, MAX_OUTPUT) if data is not None else []


def entropy_class(bits) -> "F.Column":
    return F.when(bits > 7.5, "Encrypted").when(bits > 6.5, "Compressed").when(bits > 4.5, "Mixed").when(bits > 2.0, "Structured").otherwise("Repetitive")


def auto_decoded(df: DataFrame, key: str, data: str = "data", depth: int = 3, most: int = MAX_OUTPUT) -> DataFrame:
    """key, chain, data, printable: every output of every chain up to depth over bytes, a batch at a time.

    Short values that a batch holds several times are decoded once.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = b.column(0), b.column(1)
            known: dict[bytes, list] = {}
            rows: list[int] = []
            held: list[tuple[list[str], bytes, bool]] = []
            size = 0
            for k in range(b.num_rows):
                value = values[k].as_py()
                found = known.get(value, []) if value is not None else []
                if value is not None and not found:
                    found = _walked(value, depth, most)
                    if len(value) <= _SHORT:
                        known[value] = found
                rows += [k] * len(found)
                held += found
                size += sum(len(o) for _, o, _ in found)
                if held and (len(held) >= _ROWS or size >= _BYTES or k + 1 == b.num_rows):
                    chains, outs, shown = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(chains, pa.list_(pa.string())), pa.array(outs, pa.binary()), pa.array(shown, pa.bool_())], names=[key, "chain", "data", "printable"])
                    rows, held, size = [], [], 0

    return df.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, f"`{key}` {kind}, chain array<string>, data binary, printable boolean")


def decoded_strings(df: DataFrame, key: str, text: str = "text", depth: int = 3) -> DataFrame:
    """key, chain, decoded: what texts decode to that is printable, another text and longer than three bytes."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.encode(F.col(text), "UTF-8").alias("data"))
    found = auto_decoded(rows, key, "data", depth)
    return found.where(F.col("printable") & (F.octet_length("data") > 3)).select(key, F.array_join("chain", "|").alias("chain"), F.col("data").cast("string").alias("decoded"))


def register(spark: SparkSession) -> None:
    """Makes apply_chain(bytes, chain), entropy(text), looks_generated(name) and the table function auto_decode known to SQL."""

    @F.pandas_udf("binary")
    def chained(data: pd.Series, chain: pd.Series) -> pd.Series:
        def one(v, c):
            try:
                return None if v is None or c is None else apply_chain(bytes(v), c)
            except ValueError:
                return None

        return pd.Series([one(v, c) for v, c in zip(data, chain, strict=True)])

    @F.pandas_udf("double")
    def entropy(text: pd.Series) -> pd.Series:
        return pd.Series(entropy_of(pa.array([(t or "").encode("utf-8", "replace") for t in text], pa.large_binary())))

    @F.pandas_udf("boolean")
    def generated(name: pd.Series) -> pd.Series:
        def one(n):
            label, dot, _ = (n or "").partition(".")
            size, count = len(label.encode()), lambda kind: sum(c in kind for c in label)
            vowels, digits = count("aeiou"), count("0123456789")
            return bool(dot) and size >= 8 and (vowels == 0 or count("bcdfghjklmnpqrstvwxyz") > 5 * vowels or digits >= size // 2)

        return name.map(one)

    for name, f in (("apply_chain", chained), ("entropy", entropy), ("looks_generated", generated)):
        spark.udf.register(name, f)
    spark.udtf.register("auto_decode", AutoDecode)
