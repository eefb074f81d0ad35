"""Shards by vector bin packing.

Documents with equal texts form a group, which has a size in bytes, tokens and rows. A
group goes to the shard whose residual capacity has the largest dot product with the
group's size, all three as shares of the totals, so they are balanced jointly.

A group of more than a shard in any of the three is split by its documents' numbers
into parts of about a quarter; there are at most 3 x shards such groups. The heavy parts
and groups (more than 1/``FINE`` of a shard, so at most 3 x shards x ``FINE`` of them)
are placed first, on the driver. All others are dealt to lots of a few thousand, and
each lot is packed on its own into its share of what is left of each shard. Texts never
move: only hashes and sizes are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8

#: A heavy group has more than 1/FINE of a shard; groups of a lot.
FINE, LOT = 64, 10_000
#: Bytes that each document counts beside its text.
OVERHEAD = 16
SIZES = ("bytes", "tokens", "rows")
#: Weights of the three in the dot product. Where all three can be met, as in ordinary texts, any weights do;
#: where they can't (many short copies), bytes come first, as the shards' law is on them.
WEIGHTS = np.array([64.0, 1.0, 1.0])


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of shares), largest first; ``residual`` is updated."""
    out = np.empty(len(items), np.int32)
    weighed = items * WEIGHTS
    for i in np.argsort(-weighed.max(axis=1, initial=0), kind="stable"):
        out[i] = shard = int(np.argmax(residual @ weighed[i]))
        residual[shard] -= items[i]
    return out


def sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (id, size, crc, group keys, tokens) for each row, without the text."""
    body = utf8(F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("bytes"),
        (F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("bigint").alias("tokens"),
        F.crc32(body).alias("crc"),
        F.xxhash64(text).alias("key"),
    )


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, size, text_crc32, shard, slot, tokens) for each row.

    Size is the UTF-8 bytes of the text and ``OVERHEAD``; a null text has none and shares
    a group with the empty one. Tokens are estimated by white space. Slots number a
    shard's rows from 0 without gaps. Rows that repeat an id, and null ids, are rows of
    their own. An empty table gives no rows.
    """
    # The number of a row is written with it, and so stays whatever is computed again.
    rows = cut(sizes(docs, id_col, text_col).withColumn("number", F.monotonically_increasing_id()))
    groups = rows.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.sum("bytes"), F.sum("tokens"), F.count(F.lit(1))).first()
    capacity = np.array([max(1, n or 0) for n in total], float) / shards
    limit = capacity / FINE
    share = F.greatest(*[F.col(c) / float(n) for c, n in zip(SIZES, limit, strict=True)])
    # At most ``shards`` groups can be over a shard in each of the three sizes.
    hot = groups.where(share > FINE).select("key", F.ceil(share * 4 / FINE).cast("int").alias("parts"))
    split = rows.join(F.broadcast(hot), "key", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("number", F.lit(1)), F.col("parts"))).cast("int")
    )
    units = cut(
        split.groupBy("key", "part").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    )
    heavy = units.where(share > 1).orderBy("key", "part").collect()
    residual = np.ones((shards, 3))
    homes = place(np.array([[u[c] for c in SIZES] for u in heavy], float).reshape(-1, 3) / capacity, residual)
    light = units.where(share <= 1)
    lots = max(1, -(-light.count() // LOT))

    def pack(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["key", "part"], kind="stable")
        items = lot[list(SIZES)].to_numpy(float) / capacity
        free = np.maximum(residual, 1e-9)
        own = free / free.sum(axis=0) * items.sum(axis=0)
        return pd.DataFrame({"key": lot["key"], "part": lot["part"], "shard": place(items, own.copy())})

    dealt = light.withColumn("lot", F.pmod(F.xxhash64("key", "part"), F.lit(lots)))
    placed = dealt.groupBy("lot").applyInPandas(pack, "key bigint, part int, shard int")
    if heavy:
        spark = docs.sparkSession
        placed = placed.union(spark.createDataFrame([(u["key"], u["part"], int(h)) for u, h in zip(heavy, homes, strict=True)], placed.schema))
    assigned = split.select("id", "bytes", "tokens", "crc", "key", "part", "number").join(placed, ["key", "part"])
    return slots(assigned).select(
        F.col("id").alias(id_col), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot", "tokens"
    )


def slots(assigned: DataFrame) -> DataFrame:
    """Add ``slot``: numbers within ``shard`` from 0 without gaps, by rows' numbers in small bins."""
    bins = max(1, int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    binned = cut(assigned.withColumn("bin", F.pmod(F.xxhash64("number"), F.lit(bins)).cast("int")))
    counts = binned.groupBy("shard", "bin").count()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shard and bin: bounded by the shards and the session's partitions.
    starts = counts.select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bin").orderBy("number")
    numbered = binned.withColumn("own", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bin"]).withColumn("slot", (F.col("start") + F.col("own")).cast("bigint"))
