"""Writers: partitioned files, one write per table, no row-id column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> str:
    # An empty text (a day without a peak) must not read back as null.
    df.write.mode(mode).partitionBy(*partition_by).csv(path, header=True, nullValue="NA", emptyValue='""')
    return path


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_series(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Cleaned series in stamp order: a range partitioned sort, written in parallel."""
    ordered = df.orderBy("series_id", "ts")
    return write_csv(ordered, path, mode=mode) if fmt == "csv" else write_parquet(ordered, path, mode=mode)


FILE_ROWS = 1_000_000


def sized(df: DataFrame, keys: dict[str, Column], rows: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` (name -> expression), each of their groups over as many parts as its rows ask for.

    Groups are counted first, so a group of any size is spread, and small ones make one file each.
    The counts have one row for each group, a table adaptive execution may broadcast."""
    named = df.withColumns({f"_{n}": c for n, c in keys.items()})
    names = [f"_{n}" for n in keys]
    parts = named.groupBy(*(F.col(n).alias(f"_of{n}") for n in names)).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    # Nulls are a group of their own.
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names])
    dealt = named.join(parts, same).drop(*(f"_of{n}" for n in names))
    return dealt.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts"))).repartition(*names, "_part").drop(*names, "_parts", "_part")


def write_stations(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """One folder per station and day inside it, so that a scan of some stations or days reads their files
    only. A station's days are written by as many tasks as their rows ask for."""
    day = F.date_format("ts", "yyyy-MM-dd")
    spread = sized(df.withColumn("day", day), {"station": F.col("station"), "month": F.substring("day", 1, 7)})
    writer = write_csv if fmt == "csv" else write_parquet
    return writer(spread, path, ("station", "day"), mode)


def write_by_year(df: DataFrame, path: str, day: str, fmt: str = "csv", mode: str = "errorifexists",
                  rows: int = FILE_ROWS) -> str:
    """Daily metrics or prediction logs, one folder per year. A month's rows are dealt to
    as many tasks as their number asks for, so files neither multiply with tasks nor hold a whole month of all series."""
    writer = write_csv if fmt == "csv" else write_parquet
    by_month = sized(df.withColumn("year", F.year(day)), {"year": F.col("year"), "month": F.month(day)}, rows)
    return writer(by_month, path, ("year",), mode)
