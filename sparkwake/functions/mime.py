"""MIME types of bytes, and what artifacts they make, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes in hexadecimal and the type they tell (fixed values).
MAGIC = (("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("7F454C46", "application/x-elf"), ("4D5A", "application/x-pe"), ("25504446", "application/pdf"))
#: Kinds of artifacts by words of a type, the first that occurs (fixed values).
KINDS = ((("image/",), "Image"), (("zip", "tar"), "Archive"), (("pdf", "document"), "Document"), (("elf", "pe", "executable"), "Executable"), (("certificate", "x509"), "Certificate"))
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "application/zip": "zip", "application/gzip": "gz", "application/pdf": "pdf", "application/x-elf": "elf", "application/x-pe": "exe", "text/html": "html", "text/plain": "txt"}


def printable_share(data: Column) -> Column:
    """Share of bytes that are printable ASCII, line breaks or tabs; null without bytes."""
    text = F.decode(data, "ISO-8859-1")
    return F.char_length(F.regexp_replace(text, r"[^\x20-\x7e\n\r\t]", "")) / F.nullif(F.octet_length(data), F.lit(0))


def by_magic(data: Column) -> Column:
    """The type of bytes: by their first bytes (four are needed, gzip needs two), else by their printable share."""
    start = F.hex(F.substring(data, 1, 4))
    out = F.when(F.lit(False), "")
    for magic, name in MAGIC:
        out = out.when((F.octet_length(data) >= 4) & start.startswith(magic), name)
    return out.when(start.startswith("1F8B"), "application/gzip").when(printable_share(data) > 0.85, "text/plain").otherwise("application/octet-stream")


def kind_of(mime: Column) -> Column:
    out = F.when(F.lit(False), "")
    for words, kind in KINDS:
        for w in words:
            out = out.when(mime.startswith(w) if w.endswith("/") else F.contains(mime, F.lit(w)), kind)
    return out.otherwise("File")


def extension_of(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, mime), F.lit("bin"))
