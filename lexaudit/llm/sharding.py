"""Sharding by jump consistent hashing: no ring table, and an added shard takes only its own share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each shard is numbered in so many independent parts, by further digits of the key's digest.
BINS = 4096
#: Equal rows are written out so many at a time.
CHUNK = 65_536


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the published jump consistent hash."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.float64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = (shard[live] + 1) * ((1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        live = live[ahead[live] < n_shards]
    return shard


def jump_column(key: Column, n_shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), n_shards).astype(np.int32))

    return shard(key)


def assign(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law, shard, slot, grown_shard.

    The shard follows from the id and n_shards alone, so equal ids share a shard; grown_shard is the
    one with n_shards + 1. size is the text's UTF-8 bytes plus 8, text_crc32 its unsigned CRC-32; a
    null text counts as empty. A null id is a key of its own. Repeated rows keep a slot each. An
    empty table gives no rows; other columns are ignored, whatever their names.

    Slots count from 0 in each shard without gaps. Equal rows are counted before the shuffle; a
    shard's bins are numbered apart from each other and shifted by a prefix sum over the bins'
    counts, so that no task sees a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
        .groupBy("id", "size", "crc")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("key", key).withColumn("bin", (F.conv(F.substring(digest, 16, 6), 16, 10).cast("long") % bins).cast("int"))
    rows = rows.withColumn("shard", jump_column(F.col("key"), n_shards)).withColumn("grown", jump_column(F.col("key"), n_shards + 1))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("shard", "bin").agg(F.sum("n").alias("n"))
    starts = starts.select("shard", "bin", before(Window.partitionBy("shard").orderBy("bin")).alias("start"))
    placed = rows.withColumn("within", before(Window.partitionBy("shard", "bin").orderBy("id", "size", "crc")))
    first = F.col("start") + F.col("within") + F.col("part") * chunk
    slot = F.explode(F.sequence(first, first + F.least(F.lit(chunk), F.col("n") - F.col("part") * chunk) - 1))
    parts = placed.join(starts, ["shard", "bin"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    return parts.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slot.alias("slot"), F.col("grown").alias("grown_shard")
    )
