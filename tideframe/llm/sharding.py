"""Shards by jump consistent hashing, with a gapless place in each shard.

The shard follows from the row's key and the number of shards alone: no ring,
no table. A shard more takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.names import q
from tideframe.llm import text as tx

CELLS = 4_096       # cells of a shard that places are counted in; three hex digits


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, by the published generator."""
    keys = keys.astype(np.uint64)
    out, target = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.float64)
    going = np.arange(len(keys))
    while len(going):
        out[going] = target[going]
        keys[going] = keys[going] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (keys[going] >> np.uint64(33)).astype(np.float64) + 1
        target[going] = np.floor((out[going] + 1) * (2.0 ** 31 / draw))
        going = going[target[going] < shards]
    return out.astype(np.int32)


def digest(key: Column) -> Column:
    """32 hex digits of the key as text; a null key has one of its own."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary"))


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def at(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    half = [F.conv(F.substring(digest(key), i, 8), 16, 10).cast("long") for i in (1, 9)]
    return at(F.shiftleft(half[0], 32).bitwiseOR(half[1]))


def assign(df: DataFrame, shards: int, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard, slot (gapless from 0 in its shard) and grown_shard, the shard if there were one more.

    The shard follows from the key alone; slots go by the digest of the key and
    ``ties``, then by these, so the rows of one key spread over the cells that
    places are counted in as far as their ties differ. Rows alike in all of them
    are interchangeable. Null keys share one shard, as do repeated keys. No rows
    give no rows. A column of ``df`` named like an added one is replaced.
    """
    df = df.drop("shard", "slot", "grown_shard")
    cell, before = tx.unused(df, "_cell", "_before")
    k, more = F.col(q(key)), [F.col(q(t)) for t in ties]
    mark = F.concat_ws(":", digest(k), *[F.md5(F.coalesce(t.cast("string"), F.lit("")).cast("binary")) for t in more])
    df = df.withColumns({"shard": shard_of(k, shards), "grown_shard": shard_of(k, shards + 1),
                         cell: F.conv(F.substring(F.md5(mark.cast("binary")), 17, 3), 16, 10).cast("int")})
    cells = df.groupBy("shard", cell).agg(F.count(F.lit(1)).alias("n"))
    sooner = F.sum("n").over(Window.partitionBy("shard").orderBy(cell)) - F.col("n")    # CELLS rows a shard at most
    cells = cells.select("shard", cell, sooner.alias(before))
    place = Window.partitionBy("shard", cell).orderBy(k, *more)
    return df.withColumn("slot", (F.row_number().over(place) - 1).cast("long")).join(cells, ["shard", cell]) \
        .withColumn("slot", F.col("slot") + F.col(before)).drop(cell, before)
