"""Identifiers: content hashes, element ids, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import let

OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"  # fixed value: the OID namespace of RFC 4122


def uuid5(name: Column) -> Column:
    """The version 5 UUID of ``name`` in the OID namespace."""

    def written(h: Column) -> Column:
        cut = lambda at, n: F.substring(h, at, n)
        variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))

    return let(F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(name, "UTF-8"))), written)


def element_id(sha256: Column, page_idx: Column, seq: Column) -> Column:
    return uuid5(F.concat_ws(":", sha256, page_idx.cast("string"), seq.cast("string")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(sha256: Column, mtime_ms: Column) -> Column:
    """The content's hash, cut to 32 digits, and its time of change in milliseconds."""
    return F.concat_ws("_", F.substring(sha256, 1, 32), mtime_ms.cast("string"))


def cache_name(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 16), F.lit(".json"))


def batch_name(position: Column, stem: Column) -> Column:
    """A name that no two files of a batch share."""
    return F.concat_ws("_", position.cast("string"), stem)
