"""Fingerprints of a table's schema, columns, shape and content."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col


def schema_hash(df: DataFrame) -> str:
    return hashlib.md5(json.dumps(dict(df.dtypes), sort_keys=True).encode()).hexdigest()


def column_hash(df: DataFrame) -> str:
    return hashlib.md5(json.dumps(df.columns).encode()).hexdigest()


def row_text(df: DataFrame):
    """A row as text: fields between unit separators, a gap as one record separator."""
    return F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x1e")) for c in df.columns])


def content_hash(df: DataFrame) -> DataFrame:
    """rows and content: a hash of the multiset of rows, whatever their order and partitions.

    The first 60 bits of each row's MD5 are summed exactly; a sum is taken in
    parts before it is shuffled, and no row is sorted.
    """
    digits = F.conv(F.substring(F.md5(row_text(df)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digits), F.lit(0)).cast("string").alias("content"))


def fingerprint(df: DataFrame) -> dict[str, str]:
    found = content_hash(df).first()
    shape = hashlib.md5(f"({found.rows}, {len(df.columns)})".encode()).hexdigest()
    return {"schema": schema_hash(df), "columns": column_hash(df), "shape": shape, "content": hashlib.sha256(f"{found.rows}:{found.content}".encode()).hexdigest()}
