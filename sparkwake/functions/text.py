"""Sweeps of text for URLs, addresses, blobs, flags and credentials in built-in functions, and the entropy of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> pattern and least length (fixed values).
SWEEPS = {
    "Url": (r"""https?://[^\s<>"']+""", 0),
    "Email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
    "Ipv4": (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", 0),
    "Base64Blob": (r"[A-Za-z0-9+/]{20,}={0,2}", 24),
    "HexBlob": (r"\b[0-9a-fA-F]{32,}\b", 32),
}
#: Words that flags begin with, in order; then any word (fixed values).
FLAG_WORDS = ("flag", "ctf", "ctfa", "ctfb", "picoctf", "htb", "thm", "hack", "key", "secret", "flg")
FLAGS = (*(rf"(?i){w}\{{[^}}]{{1,200}}\}}" for w in FLAG_WORDS), r"[a-zA-Z]{2,12}\{[^}]{1,200}\}")
#: Credential kinds of our own choice: kind, pattern, group.
CREDENTIALS = (
    ("BearerToken", r"[Bb]earer ([A-Za-z0-9._~+/-]{8,}=*)", 1), ("Jwt", r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*", 0), ("ApiKey", r"AKIA[A-Z0-9]{16}", 0),
    ("ApiKey", r"gh[poshru]_[A-Za-z0-9]{20,}", 0), ("ApiKey", r"xox[bpasr]-[A-Za-z0-9-]{10,}", 0), ("ApiKey", r"(?:api_key|secret_key|access_token)=([A-Za-z0-9._-]{8,})", 1), ("SshPrivateKey", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("HttpFormLogin", r"password=([^&\s]{4,})", 1),
)


def sweep(df: DataFrame, kind: str, key: str, text: str = "text") -> DataFrame:
    """key, value: a row per match of a kind."""
    pattern, least = SWEEPS[kind]
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("value"))
    return found.where(F.char_length("value") >= least) if least else found


def flags(text: Column) -> Column:
    """Distinct flags of a text, in the order of patterns and places."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in FLAGS])))


def credentials(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, value: a row per distinct credential of a row, one scan of df."""
    def found(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = F.array(*[found(*x) for x in CREDENTIALS])
    return df.select(key, F.explode(F.array_distinct(F.flatten(each))).alias("c")).select(key, "c.kind", "c.value")


def entropy_of(data: pa.Array) -> np.ndarray:
    """Shannon entropy in bits of each binary value, 0 for those without bytes: one count over a value's bytes."""
    out = np.zeros(len(data))
    ends, raw = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1], np.frombuffer(data.buffers()[2] or b"", np.uint8)
    for k in range(len(data)):
        if ends[k + 1] > ends[k]:
            n = np.bincount(raw[ends[k] : ends[k + 1]], minlength=256)
            n = n[n > 0]
            out[k] = np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()
    return out


def byte_entropy(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, entropy: Shannon entropy in bits of a text's bytes, for every row; rows without bytes have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(entropy_of(b.column(1).cast(pa.large_binary())))], names=[key, "entropy"])

    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes_"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, entropy double")


def rot13(text: Column) -> Column:
    a, b = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "NOPQRSTUVWXYZABCDEFGHIJKLM"
    return F.translate(text, a + a.lower(), b + b.lower())
