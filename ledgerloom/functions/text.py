"""Tokens, hashes, vectors and ids of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEM = 6
#: Namespace of point ids (our own UUID).
NAMESPACE = "5b0c4f0e7d3a4f5c9a1e2b6d8c7f1a20"


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and ``_``, cut to six characters."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda x: F.substring(x, 1, STEM))


def stems(text: Column) -> Column:
    """Words of three characters or more that begin with a letter, cut to six."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("\\p{L}[\\p{L}\\p{Nd}]{2,}"), F.lit(0)), lambda x: F.substring(x, 1, STEM))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a bigint. Byte by byte: use it on distinct tokens."""
    raw = F.encode(token, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")
    start = F.lit(2166136261).cast("bigint")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.when(F.length(token) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.octet_length(raw)), start, step))


def point_id(page_id: Column, section: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5 bits) of a page's section."""
    name = F.concat(page_id, F.lit("\n"), section)
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(3).cast("bigint"))).bitwiseOR(F.lit(8).cast("bigint"))))
    h = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n"), section, F.lit("\n\n"), text)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of parts with a separator that texts don't hold."""
    return F.sha2(F.concat_ws("\n\u0001", *parts), 256)
