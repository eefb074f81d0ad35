"""Approximate search for the largest inner product by score-aware quantisation.

Vectors are cut into subspaces of ``SUB`` dimensions, each coded in four bits. Training
and coding weigh the part of the residual that is parallel to the vector ``eta`` times
as much as the rest, as it is what changes large inner products. A query's table of
centre scores is summed over the codes of a block of vectors, and the best of the block
are scored exactly on the original vectors. So is every other vector whose code's score,
and the most that its residual can add, reaches the last of the ``top`` of those: what is
found is exact, however little the codes tell near copies apart.

Queries and vectors meet in blocks: each pair of a query block and a vector block is one
task's work, of a bounded size. Vectors of different lengths never meet; centres are those
of the most common length, and others are scored without codes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, usable

SUB, CENTRES = 2, 16
#: Vectors of the training sample, threshold of the score-aware weight, and sweeps.
SAMPLE, SCORE_T, SWEEPS, ROUNDS = 4096, 0.2, 2, 6
#: Rows of a block of queries and of a block of vectors, and vectors reranked first in each.
QUERY_BLOCK, VECTOR_BLOCK, RERANK = 4096, 16384, 256
#: Queries that are multiplied with a block of vectors at once.
CHUNK = 64


def eta(dims: int) -> float:
    """Weight of the parallel residual, for inner products above ``SCORE_T`` of the norm."""
    return max(1.0, (dims - 1) * SCORE_T**2 / (1 - SCORE_T**2))


def parts_of(x: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces (rows, subspaces, SUB), the last filled with zeros."""
    fill = -x.shape[1] % (2 * SUB)
    return np.pad(x, ((0, 0), (0, fill))).reshape(len(x), -1, SUB)


def code(x: np.ndarray, centres: np.ndarray, weight: float) -> np.ndarray:
    """Codes (rows, subspaces) by coordinate descent on the score-aware loss."""
    parts = parts_of(x)
    k = (weight - 1) / np.maximum((x * x).sum(1), 1e-30)
    flat = np.stack([((parts[:, m, None, :] - centres[m]) ** 2).sum(-1) for m in range(parts.shape[1])], 1)
    along = np.stack([(parts[:, m] * parts[:, m]).sum(-1)[:, None] - parts[:, m] @ centres[m].T for m in range(parts.shape[1])], 1)
    codes = flat.argmin(-1)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(SWEEPS):
        for m in range(parts.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (flat[:, m] + k[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def train(x: np.ndarray, weight: float, seed: int = 7) -> np.ndarray:
    """Centres (subspaces, CENTRES, SUB) by turns of coding and weighted least squares."""
    rng = np.random.default_rng(seed)
    parts = parts_of(x)
    centres = np.stack([parts[rng.integers(0, len(x), CENTRES), m] for m in range(parts.shape[1])])
    k = (weight - 1) / np.maximum((x * x).sum(1), 1e-30)
    for turn in range(ROUNDS):
        codes = code(x, centres, 1.0 if turn < 2 else weight)
        w = np.zeros_like(k) if turn < 2 else k
        chosen = centres[np.arange(parts.shape[1]), codes]
        along = ((parts - chosen) * parts).sum(-1)
        total = along.sum(1)
        for m in range(parts.shape[1]):
            p, rest = parts[:, m], total - along[:, m]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if not own.any():
                    centres[m, c] = p[rng.integers(0, len(x))]
                    continue
                q, v = p[own], w[own]
                left = own.sum() * np.eye(SUB) + (q * v[:, None]).T @ q
                right = q.sum(0) + ((v * (rest[own] + (q * q).sum(1)))[:, None] * q).sum(0)
                centres[m, c] = np.linalg.solve(left, right)
    return centres


def residuals(x: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Norm of what each row's packed codes (bytes, rows) leave of it."""
    left = parts_of(x)
    for m in range(left.shape[1]):
        left[:, m] -= centres[m][codes[m // 2] >> 4 if m % 2 else codes[m // 2] & 15]
    return np.sqrt((left * left).sum((1, 2)))


def scan(queries: pd.DataFrame, rows: pd.DataFrame, centres: np.ndarray, top: int, rerank: int) -> pd.DataFrame:
    """The ``top`` best of a block of vectors for each query of a block, all of one length.

    Equal vectors are scanned once; each brings its rows of the smallest ids, ``top`` + 1 at
    most, as one of them may be the query.
    """
    rows = rows.sort_values(["id", "row"], kind="stable")
    one = rows.drop_duplicates("digest")
    members: list[list] = [[] for _ in range(len(one))]
    place = {d: i for i, d in enumerate(one["digest"])}
    for d, i, r in zip(rows["digest"], rows["id"].tolist(), rows["row"].tolist(), strict=True):
        if len(members[place[d]]) <= top:
            members[place[d]].append((i, r))
    x = matrix(one["vector"])
    first = max(rerank, top + 1)
    coded = len(one) > first and one["codes"].notna().all()
    if coded:
        codes = np.frombuffer(b"".join(one["codes"]), np.uint8).reshape(len(one), -1).astype(np.intp)
        codes = np.ascontiguousarray(codes.T)
        single, size, left = x.astype(np.float32), np.linalg.norm(x, axis=1), residuals(x, codes, centres)
        # What sums of so many terms in single precision can be wrong by, of the norms' product.
        wrong = (x.shape[1] + 8) * 2.0**-22
    asked, chunk = matrix(queries["vector"], x.shape[1]), None
    out = []
    for k, (query, own, q) in enumerate(zip(queries["id"], queries["row"], asked, strict=True)):
        if k % CHUNK == 0:
            chunk = None
        best = np.arange(len(one))
        if coded:
            scores = (parts_of(q[None])[0][:, None, :] * centres).sum(-1).astype(np.float32)
            pairs = (scores[1::2, :, None] + scores[::2, None, :]).reshape(len(scores) // 2, -1)
            near = np.zeros(len(one), np.float32)
            for table, column in zip(pairs, codes, strict=True):
                near += table.take(column)
            norm = np.linalg.norm(q)
            best = np.argpartition(-near, first)[:first]
            # One more than the top, as one of them may be the query.
            reached = np.partition(x[best] @ q, first - top - 1)[first - top - 1] - wrong * norm * size.max()
            fit = near + norm * (left + wrong * (left + size)) >= reached
            if fit.sum() > first:
                if chunk is None:
                    chunk = asked[k - k % CHUNK :][:CHUNK].astype(np.float32) @ single.T
                direct = chunk[k % CHUNK]
                sure = direct - norm * wrong * size
                reached = max(reached, np.partition(sure, len(sure) - top - 1)[len(sure) - top - 1])
                fit &= direct + norm * wrong * size >= reached
            best = np.nonzero(fit)[0]
        exact = np.einsum("ij,j->i", x[best], q)
        found, least = [], -np.inf
        for i in np.argsort(-exact, kind="stable"):
            if len(found) >= top and exact[i] < least:
                break
            found += [(exact[i], v) for v, r in members[best[i]] if r != own]
            least = exact[i]
        found.sort(key=lambda f: (-f[0], f[1]))
        out += [(query, own, v, s) for s, v in found[:top]]
    return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])


def search(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, rerank: int = RERANK) -> DataFrame:
    """Return (query_id, rank, vec_id, score) of the ``top`` nearest found for each query.

    Queries are the rows where ``is_query`` holds; candidates are all other rows of the same
    length. Ties go to the smaller id. Rows that repeat an id are queries and candidates of
    their own. Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part. An empty table gives no rows.
    """
    rows = usable(table, id_col, vector_col).where("digest is not null and id is not null")
    rows = cut(rows.withColumn("dims", (F.octet_length("vector") / 8).cast("int")).withColumn("row", F.monotonically_increasing_id()))
    counts = rows.groupBy("dims").count()
    lengths = counts.orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 1
    common = rows.where(F.col("dims") == dims)
    sample = matrix([r[0] for r in common.orderBy(F.xxhash64("id", "row"), "id", "row").select("vector").limit(SAMPLE).collect()], dims)
    weight = eta(dims)
    centres = train(sample, weight) if len(sample) else np.zeros((1, CENTRES, SUB))

    def coded(batches):
        for batch in batches:
            fit = (batch["dims"] == dims).to_numpy()
            codes = np.full(len(batch), None, object)
            if fit.any():
                own = code(matrix(batch["vector"][fit]), centres, weight)
                codes[fit] = [c.tobytes() for c in own[:, 1::2] << 4 | own[:, ::2]]
            yield batch.assign(codes=codes)

    kind = rows.schema["id"].dataType.simpleString()
    index = rows.mapInPandas(coded, f"id {kind}, digest binary, vector binary, dims int, row bigint, codes binary")
    queries = rows.where(is_query(F.col("id"))).select("id", "row", "vector", "dims")
    blocks = max(1, -(-rows.count() // VECTOR_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block, query_block = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row"), F.lit(query_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.select("*", query_block.alias("qb"), each(blocks).alias("vb"))
    right = index.select("*", block.alias("vb"), each(query_blocks).alias("qb"))
    keys = ["dims", "qb", "vb"]

    def met(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return scan(q, v, centres, top, rerank) if len(q) and len(v) else scan(q.iloc[:0], v.iloc[:0], centres, top, rerank)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, f"query_id {kind}, query_row bigint, vec_id {kind}, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
