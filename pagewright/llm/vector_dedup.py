"""Near-duplicate vectors by sorted projection passes, and exact counts in what they join.

Each pass draws random hyperplanes, orders all vectors lexicographically by the
concatenated sign hashes, and compares each vector with its ``window`` successors in
that order. Pairs that reach the cosine join components; the more rows, the more passes
(see ``passes_for``). All pairs of a component are then compared, by blocks, so that
``n_links`` doesn't depend on the window, however many rows a group has. Links are
counted in the blocks and never listed.
Equal vectors are one entry with a count, so copies are never compared.

A pass is a range partitioning and a sort. The order is then cut into blocks of equal
numbers of rows, each with the ``window`` rows before it, so that a block's work and
memory are bounded whatever the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot
from .graph import components
from .vectors import matrix, usable

#: Random orders at least, hashes in each, and successors that a vector is compared with.
PASSES, HASHES, WINDOW = 8, 60, 512
#: Share of lone pairs at the threshold that the passes are to join, where rows lie evenly.
RECALL = 0.99
BLOCK = 4096


def planes(dims: int, number: int) -> np.ndarray:
    return np.random.default_rng([number, dims]).standard_normal((dims, HASHES))


def passes_for(rows: int, threshold: float, window: int) -> int:
    """Passes after which a pair at the threshold has shared a window with probability ``RECALL``.

    A window covers the rows that agree in about log2(rows / window) hashes.
    """
    one = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    same = one ** np.log2(max(1.0, rows / window))
    return PASSES if same >= 1 else max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(same, RECALL)))))


def reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of ``x`` with each of ``y`` (unit rows) reaches the threshold."""
    near = x.astype(np.float32) @ y.astype(np.float32).T
    margin = np.float32(max(1e-5, 2e-7 * x.shape[1]))
    out = near >= threshold
    a, b = np.nonzero(np.abs(near - np.float32(threshold)) <= margin)
    for i in range(0, len(a), 1 << 16):
        c, d = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        out[c, d] = np.einsum("ij,ij->i", x[c], y[d]) >= threshold
    return out


def roots(a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """The least row that the links (a, b) reach from each of ``number`` rows."""
    root = np.arange(number)
    while True:
        c, d = root[a], root[b]
        differ = c != d
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(c, d)[differ], np.minimum(c, d)[differ])
        while (root[root] != root).any():
            root = root[root]


def unit_rows(vectors) -> np.ndarray:
    full = matrix(vectors)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def compare(block: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """What the pairs within the window whose cosine reaches the threshold join: each row with the first of its group."""
    block = block.sort_values("rank", kind="stable").reset_index(drop=True)
    pairs: list[tuple] = []
    for _, rows in block.groupby(["pass", "dims"], sort=False):
        full = unit_rows(rows["vector"])
        rank, halo, ids = rows["rank"].to_numpy(), rows["halo"].to_numpy(), rows["digest"].to_numpy()
        step = 256
        links = []
        for i in range(0, len(full), step):
            a, b = np.nonzero(reaches(full[i : i + step], full[i + 1 : i + step + window], threshold))
            a, b = a + i, b + i + 1
            fit = (b > a) & (rank[b] - rank[a] <= window) & ~(halo[a] & halo[b])
            links.append((a[fit], b[fit]))
        root = roots(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]), len(full))
        joined = np.nonzero(root != np.arange(len(full)))[0]
        pairs += zip(ids[root[joined]], ids[joined], strict=True)
    return pd.DataFrame({"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]})


def near_pairs(distinct: DataFrame, threshold: float, passes: int | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of digests that chains of links join, a link being a cosine of at least ``threshold``."""
    if passes is None:
        passes = passes_for(distinct.count(), threshold, window)

    def hashed(batches):
        weights = 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            x = [np.frombuffer(v, "<f8") for v in batch["vector"]]
            for p in range(passes):
                keys = [int(((v @ planes_of(len(v), p)) > 0).astype(np.int64) @ weights) for v in x]
                yield batch.assign(**{"pass": p, "dims": [len(v) for v in x], "key": keys})

    drawn: dict[tuple, np.ndarray] = {}

    def planes_of(dims: int, number: int) -> np.ndarray:
        if (dims, number) not in drawn:
            drawn[dims, number] = planes(dims, number)
        return drawn[dims, number]

    def numbered(batches):
        from pyspark import TaskContext

        own, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(part=own, place=np.arange(n, n + len(batch)))
            n += len(batch)

    columns = "digest binary, vector binary, pass int, dims int, key bigint"
    keyed = distinct.select("digest", "vector").mapInPandas(hashed, columns)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of equal keys lie in another order in each pass, so that they meet others there.
    order = ("pass", "dims", "key", F.xxhash64("digest", "pass"))
    ordered = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(numbered, columns + ", part int, place bigint"))
    # One count for each partition, whatever the number of rows.
    before, offsets = 0, {}
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):
        offsets[part], before = before, before + n
    starts = ordered.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "part int, start bigint")
    ranked = ordered.join(F.broadcast(starts), "part").select("digest", "vector", "pass", "dims", (F.col("start") + F.col("place")).alias("rank"))
    home = F.floor(F.col("rank") / block)
    places = F.when(F.col("rank") % block >= block - window, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = ranked.withColumn("block", F.explode(places)).withColumn("halo", F.col("block") != home)
    found = dealt.groupBy("block").applyInPandas(lambda rows: compare(rows, threshold, window), "a binary, b binary")
    return found.distinct()


def link_counts(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(digest, links) of the rows of a block of components, or of a pair of buckets (i, j) of one."""
    digests, counts = [], []
    for _, part in rows.groupby("root", sort=False):
        own = part["bucket"] == part["i"]
        x, y = part[own], part[part["bucket"] == part["j"]]
        same = bool((part["i"] == part["j"]).iloc[0])
        left, right = unit_rows(x["vector"]), unit_rows(y["vector"])
        weigh_x, weigh_y = x["size"].to_numpy(float), y["size"].to_numpy(float)
        to_x, to_y = np.zeros(len(x)), np.zeros(len(y))
        step = 512
        for k in range(0, len(left) if len(right) else 0, step):
            near = reaches(left[k : k + step], right, threshold)
            if same:
                np.fill_diagonal(near[:, k:], False)
            near = near.astype(float)
            to_x[k : k + step] = near @ weigh_y
            to_y += weigh_x[k : k + step] @ near
        digests.append(x["digest"])
        counts.append(to_x)
        if not same:
            digests.append(y["digest"])
            counts.append(to_y)
    return pd.DataFrame({"digest": pd.concat(digests), "links": np.concatenate(counts).astype(np.int64)})


def all_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Return (digest, links): the rows of other vectors that each of ``members`` (digest, vector, size, root) links with.

    All pairs of a component are compared. One of more than ``block`` vectors is dealt to
    buckets, and each pair of buckets is a task's work; smaller ones share a task.
    """
    counts = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    small = F.sum(F.when(F.col("n") <= block, F.col("n")))
    bins = max(1, -(-(counts.agg(small).first()[0] or 0) // block))
    large = counts.where(F.col("n") > block).select("root", F.ceil(F.col("n") / block).cast("int").alias("buckets"))
    placed = members.join(F.broadcast(large), "root", "left").withColumn("large", F.col("buckets").isNotNull())
    placed = placed.withColumn("buckets", F.coalesce("buckets", F.lit(1))).withColumn("bucket", F.pmod(F.xxhash64("digest"), "buckets").cast("int"))
    placed = placed.withColumn("bin", F.when(F.col("large"), F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))))
    placed = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    placed = placed.withColumns({"i": F.least("bucket", "met"), "j": F.greatest("bucket", "met")}).drop("met", "buckets")
    found = placed.groupBy("large", "bin", "i", "j").applyInPandas(lambda rows: link_counts(rows, threshold), "digest binary, links bigint")
    return found.groupBy("digest").agg(F.sum("links").alias("links"))


def link_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, **passes) -> DataFrame:
    """Return (id, n_links, component_id, kept) for each row.

    A vector that is null or zero, or holds null or non-finite components, links with
    nothing and is its own component. Equal vectors always link. Rows that repeat an id
    are rows of their own with the same component. An empty table gives no rows.
    """
    rows = cut(usable(table, id_col, vector_col))
    fit = rows.where("digest is not null")
    classes = cut(fit.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector")))
    pairs = cut(near_pairs(classes, threshold, **passes))
    reach = components(pairs, "a", "b")
    again = reach.select("component").distinct().select(F.col("component").alias("node"), "component")
    members = classes.join(reach.union(again).toDF("digest", "root"), "digest").select("digest", "vector", "size", "root")
    linked = all_links(cut(members), threshold)
    named = cut(
        classes.select("digest", "least", "size")
        .join(linked, "digest", "left")
        .join(reach.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "least", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "digest").alias("root"))
    )
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    of = cut(join_hot(named, least, ["root"], "members").select("digest", "n_links", "component_id", "size"))
    joined = join_hot(fit.select("id", "digest"), of, ["digest"], "size").select("id", "n_links", "component_id")
    unfit = rows.where("digest is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(unfit).select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
