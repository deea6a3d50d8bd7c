"""Stable fingerprints and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in alphabetical order and NULLs kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def short_id(prefix: str, separator: str, length: int, *parts: Column) -> Column:
    """``prefix`` plus the first ``length`` hex digits of the joined parts' hash."""
    joined = F.concat_ws(separator, *[part.cast("string") for part in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def set_digest(row_hash: Column) -> tuple[Column, Column, Column]:
    """Order-free digest of a row set as three mergeable sums over a hex row hash.

    Sums combine map-side, so a project of any size is fingerprinted without
    gathering its rows; 28-bit slices keep the sums inside 64 bits.
    """

    def slice_sum(start: int) -> Column:
        return F.sum(F.conv(F.substring(row_hash, start, 7), 16, 10).cast("long"))

    return slice_sum(1), slice_sum(8), slice_sum(15)
