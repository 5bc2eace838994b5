"""Fingerprints of tables that do not depend on the order of rows, and what two tables differ in.

A row's hash is a number of 60 bits from its canonical text, in which each value stands with its length, so that no two rows
share a text. A part's digest is the number of rows, their bytes, the sum of hashes and their exclusive or: all four can be
merged from parts of parts, so a digest needs one aggregation without a sort, and equal multisets have equal digests.

Two tables are compared by digests first; only parts whose digests differ are read again, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = ["n", "bytes", "hash_sum", "hash_xor"]


def canonical(columns: list[str]) -> Column:
    """Text of a row: each value as length:value, NULL as a dash."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def row_hash(columns: list[str]) -> Column:
    return F.conv(F.substring(F.md5(canonical(columns).cast("binary")), 1, 15), 16, 10).cast("long")


def digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for each part (by): n, bytes, hash_sum, hash_xor."""
    rows = df.select(*by, F.octet_length(canonical(columns)).alias("__b"), row_hash(columns).alias("__h"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__b").alias("bytes"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("__h").alias("hash_xor"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Digests of larger parts from those of smaller ones."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("hash_sum").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"))


def compared(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """by, n of both and `differs`, from two tables of digests; a part that one lacks differs."""
    a, b = (d.select(*by, F.struct(*DIGEST).alias(name)) for d, name in ((first, "a"), (second, "b")))
    both = a.join(b, by, "full")
    n = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0))
    return both.select(*by, n("a").alias("n_first"), n("b").alias("n_second"), (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


def differences(first: DataFrame, second: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (by, columns, n_first, n_second) that one table has more often than the other."""
    wrong = compared(digests(first, by, columns), digests(second, by, columns), by).where("differs").select(*by)
    own = list(dict.fromkeys([*by, *columns]))
    side = lambda df, a, b: df.select(*own).join(wrong, by, "left_semi").withColumns({"n_first": F.lit(a), "n_second": F.lit(b)})
    rows = side(first, 1, 0).unionByName(side(second, 0, 1))
    return rows.groupBy(*own).agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second")).where("n_first <> n_second")
