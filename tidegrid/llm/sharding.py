"""Constant-time placement by a permutation-filled lookup table.

A table of prime size is filled by the shards in turn: each claims the first free slot of
its own permutation ``(offset + i * skip) mod size``. A heavier shard takes more turns in
a round. A key's shard is the table's entry at ``hash mod size``. Adding or removing one
shard leaves most entries as they are.

The table has ``size`` entries whatever the data (65,537 by default, under 1 MB), so its
broadcast is bounded. Placement is DataFrame functions only. A shard is a folder that many
tasks can write: ``write_shards`` counts the rows and splits each shard over as many tasks as the
largest one asks for, by a hash of the row and of the place it was read at, so neither a shard nor a
row that comes again and again becomes one task.

Defined results: a null key is placed as empty text; equal keys share a shard; an empty
table gives an empty result; ``slot`` and ``shard`` replace columns of these names, all other
columns stay, whatever their names and types.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537
TASK_ROWS = 20_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] | Mapping[str, int], size: int = SIZE) -> list[int]:
    """The shard number of each slot. ``shards``: names, or names with whole weights >= 1."""
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1 for s in shards}
    if not weights or min(weights.values()) < 1:
        raise ValueError("at least one shard, and weights of 1 or more")
    if sum(weights.values()) > size or size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the size must be a prime above the sum of weights")
    order = sorted(weights)
    offset = [_number(f"{s}/offset") % size for s in order]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in order]
    table, free = [-1] * size, size
    while True:
        for k, name in enumerate(order):
            for _ in range(weights[name]):
                while table[offset[k]] >= 0:
                    offset[k] = (offset[k] + skip[k]) % size
                table[offset[k]] = k
                free -= 1
                if not free:
                    return table


def key_hash(key: Column) -> Column:
    """Sixty bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard), one row per slot."""
    text = json.dumps(list(table), separators=(",", ":"))
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<int>")).alias("slot", "shard"))


def place(df: DataFrame, shards: Sequence[str] | Mapping[str, int], key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (number of the shard in name order)."""
    entries = F.broadcast(table_frame(df.sparkSession, lookup_table(shards, size)))
    rows = df.drop("slot", "shard").withColumn("slot", (key_hash(F.col(f"`{key}`")) % size).cast("int"))
    return rows.join(entries, "slot").select(*(F.col(f"`{c}`") for c in rows.columns if c != "slot"), "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: Sequence[str] | Mapping[str, int], key: str = "doc_id",
                 salt: int | None = None, size: int = SIZE) -> DataFrame:
    """Parquet folders ``shard=N`` of whole rows, each written by ``salt`` tasks; the rows as read back.
    Without ``salt``, the number of rows of the heaviest shard decides."""
    n = len(shards)
    if salt is None:
        weights = list(shards.values()) if isinstance(shards, Mapping) else [1] * n
        salt = max(1, math.ceil(df.count() * max(weights) / sum(weights) / TASK_ROWS))
    placed = place(df, shards, key, size)
    # Maps have no hash; the other columns tell rows apart.
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    part = F.col("shard") * salt + F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(salt)).cast("int")
    placed.repartitionById(n * salt, part).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)
