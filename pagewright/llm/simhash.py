"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments. If two fingerprints differ in at most
``radius`` bits, they differ in few bits in one segment: each fingerprint therefore
looks up a small Hamming ball around each of its segments in a table of all segments,
and what it meets is verified on all 64 bits. Equal fingerprints are one entry there,
so that copies cost nothing; the rest of the work is two hash joins.

64 bits can't tell a similarity of 0.8 from less, and no ball around their segments that
is small covers it. ``similar_documents`` therefore takes wide fingerprints of the set of
shingles, cut into more segments, of which two similar ones share one with a chosen
probability; segments are as long as the number of rows asks for, so that a bucket of
unrelated rows stays small. The rows of a bucket are compared on all bits in one task,
and only what joins them is kept; a bucket of more than ``BLOCK`` rows is dealt out, and
each pair of its parts is a task's work.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chaining import Hasher
from .common import by_column, cut, fresh, join_hot
from .graph import components
from .vector_dedup import roots

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Words of a shingle and least similarity of near-duplicate documents.
WORDS, SIMILARITY = 5, 0.8
#: Least 64-bit words of a wide fingerprint; probability that a pair at the least similarity shares a segment;
#: unrelated rows of a bucket, on average; rows of a bucket that is one task's work, and that are compared at once with others.
WIDTH, RECALL, BUCKET, BLOCK, FEW = 8, 0.95, 16, 8192, 64
#: Links that a task remembers so as not to repeat them.
KNOWN = 1 << 17


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included, as a signed integer.

    Only A-Z are lower-cased and only ASCII white space parts words. A text of fewer
    words than a shingle has is one shingle; one without words has fingerprint zero.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    values = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), CHUNK):
        bits = np.unpackbits(values[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """Return (id, text_hash bigint, fingerprint bigint) for each row."""
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), hash_of(text).alias("text_hash"), text.alias("text"))
    return by_column(texts, "text", lambda: lambda batch: [[fingerprint(t, words) for t in batch]], "fingerprint bigint")


def hash_of(text: Column) -> Column:
    """With the id, tells a row from others; rows that agree in both are equal."""
    return F.xxhash64(text)


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in on) for r in range(radius + 1) for on in combinations(range(bits), r)]


def close_pairs(distinct: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the ``fingerprint`` values that differ in 1 to ``radius`` bits.

    Segment i is searched to radius r_i, where the r_i + 1 add up to radius + 1: two
    fingerprints within the radius are then within r_i in at least one segment.
    """
    width = 64 // segments
    radii = [(radius + 1 + i) // segments - 1 for i in range(segments)]
    out = None
    for i, r in enumerate(radii):
        if r < 0:
            continue
        bits = width if i + 1 < segments else 64 - width * (segments - 1)
        part = F.shiftrightunsigned("fingerprint", width * i).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        slots = distinct.select(part.alias("part"), F.col("fingerprint").alias("b"))
        masks = F.explode(F.array(*[F.lit(m).cast("bigint") for m in ball(bits, r)]))
        probes = distinct.select(part.alias("own"), F.col("fingerprint").alias("a"), masks.alias("mask"))
        probes = probes.select(F.col("own").bitwiseXOR(F.col("mask")).alias("part"), "a")
        near = probes.join(slots, "part").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        out = near.select("a", "b") if out is None else out.union(near.select("a", "b"))
    return out


def components_of(found: DataFrame, links) -> DataFrame:
    """Add (component_id, first) to rows (id, text_hash, fingerprint) by the components of ``links(distinct)``."""
    row = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")
    distinct = cut(found.groupBy("fingerprint").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n")))
    reach = components(links(distinct), "a", "b")
    classes = distinct.join(reach, distinct["fingerprint"] == reach["node"], "left").select(
        "fingerprint", "least", "n", F.coalesce("component", "fingerprint").alias("root")
    )
    classes = cut(classes)
    named = cut(classes.groupBy("root").agg(F.min("least").alias("named"), F.count(F.lit(1)).alias("members")))
    of = cut(join_hot(classes, named, ["root"], "members").select("fingerprint", "named", "n"))
    first = F.col("id").eqNullSafe(F.col("named.id")) & (F.col("text_hash").eqNullSafe(F.col("named.text_hash")))
    return join_hot(found, of, ["fingerprint"], "n").withColumns({"component_id": F.col("named.id"), "first": first}).drop("named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Return (id, fingerprint bigint, component_id, text_hash bigint, first boolean) for each row.

    Links join fingerprints that differ in at most ``radius`` bits. A component is named
    by the smallest id in it, and ``first`` marks its first row: the one of that id, and
    of the smallest hash if the id has several texts. Null and empty texts have
    fingerprint zero and are linked like others. Rows that repeat an id are rows of their
    own; equal rows are all ``first`` or none is. Null ids come last, and name a
    component if it has no other.
    """
    found = components_of(cut(fingerprints(docs, id_col, text_col, words)), lambda distinct: close_pairs(distinct, radius))
    return found.select(F.col("id").alias(id_col), "fingerprint", "component_id", "text_hash", "first")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of hashed words; of fewer words, one of them all."""
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1 if len(words) else 0, np.uint64)
    for i in range(size):
        h = mixed(h * np.uint64(31) + words[i : i + len(h)])
    return np.unique(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` x 64 SimHash bits of a set of hashes, as bytes; all zero for the empty set."""
    ones = np.zeros(width * 64, np.int64)
    salts = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(mixed(hashes[i : i + CHUNK, None] + salts).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # so many fit into a byte
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes))


def differing(similarity: float) -> float:
    """Share of SimHash bits that differ between sets of a given Jaccard similarity and equal sizes."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def segments_for(rows: int, similarity: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a segment, segments, 64-bit words of a fingerprint) for a table of so many rows."""
    bits = int(min(32, max(10, np.ceil(np.log2(max(1, rows) / BUCKET)))))
    share = (1 - differing(similarity)) ** bits
    number = int(np.ceil(np.log(1 - recall) / np.log(1 - share)))
    return bits, number, max(WIDTH, -(-bits * number // 64))


def joined_rows(prints: np.ndarray, buckets: np.ndarray, side: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row it is joined with) of rows of the same bucket, sorted by it, that differ in at most ``limit`` bits.

    Rows of side 0 are compared with those of side 1, and rows of side 2 with each other.
    """
    left, right = [], []
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    ends = np.append(starts[1:], len(buckets))
    sizes = ends - starts
    for a, b in zip(starts[sizes > FEW].tolist(), ends[sizes > FEW].tolist(), strict=True):
        for i in range(a, b, 256):
            near = np.zeros((min(256, b - i), b - i), np.uint16)
            for w in range(prints.shape[1]):
                near += np.bitwise_count(prints[i : min(i + 256, b), w, None] ^ prints[None, i:b, w])
            x, y = np.nonzero(near <= limit)
            left.append(x + i)
            right.append(y + i)
    few = np.repeat(sizes <= FEW, sizes)
    for lag in range(1, int(min(FEW, sizes.max(initial=1)))):
        x = np.flatnonzero(few[:-lag] & (buckets[lag:] == buckets[:-lag]))
        if not len(x):
            break
        far = np.bitwise_count(prints[x] ^ prints[x + lag]).sum(axis=1, dtype=np.int32)
        left.append(x[far <= limit])
        right.append(x[far <= limit] + lag)
    a, b = (np.concatenate([np.empty(0, np.int64), *v]) for v in (left, right))
    fit = (a < b) & ((side[a] == 2) | (side[a] != side[b]))
    root = roots(a[fit], b[fit], len(prints))
    rows = np.flatnonzero(root != np.arange(len(prints)))
    return rows, root[rows]


def wide_links(distinct: DataFrame, similarity: float, bits: int, number: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of wide ``fingerprint`` values that chains of links join.

    A link is an estimated similarity and a shared one of ``number`` segments of ``bits``
    bits. The bound on the differing bits is one standard deviation loose, as the estimate
    errs to both sides.
    """
    share = differing(similarity)
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def matrix(prints) -> np.ndarray:
        return np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)

    def cut_up(whole: bool):
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        names = np.arange(number, dtype=np.int64) << 32

        def run(batches):
            for batch in batches:
                if len(batch):
                    ones = np.unpackbits(matrix(batch["fingerprint"]), axis=1)[:, : bits * number]
                    buckets = (ones.reshape(len(batch), number, bits) @ weights | names).ravel()
                    yield pd.DataFrame({"bucket": buckets, "fingerprint": batch["fingerprint"].repeat(number).to_numpy()} if whole else {"bucket": buckets})

        return run

    prints = distinct.select("fingerprint")
    placed = prints.mapInPandas(cut_up(True), "bucket bigint, fingerprint binary")
    counts = prints.mapInPandas(cut_up(False), "bucket bigint").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("dealt"))
    slots = placed.join(cut(large), "bucket", "left").withColumn("dealt", F.coalesce("dealt", F.lit(1)))
    slots = slots.withColumn("own", F.pmod(F.xxhash64("fingerprint"), "dealt").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    side = F.when(F.col("own") == F.col("met"), 2).otherwise((F.col("own") > F.col("met")).cast("int"))
    slots = slots.select("bucket", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), side.alias("side"), "fingerprint")
    keys = ["bucket", "i", "j"]
    ordered = slots.repartition(parts, *keys).sortWithinPartitions(*keys)

    def compare(rows: pd.DataFrame, seen: set) -> pd.DataFrame:
        raw = matrix(rows["fingerprint"])
        total = raw.shape[1] * 8
        limit = int(total * share + np.sqrt(total * share * (1 - share)))
        new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        a, b = joined_rows(np.ascontiguousarray(raw).view(np.uint64), np.cumsum(new), rows["side"].to_numpy(), limit)
        values = rows["fingerprint"].to_numpy()
        pairs = {(min(p), max(p)) for p in zip(values[a], values[b], strict=True)} - seen
        if len(seen) < KNOWN:
            seen |= pairs
        return pd.DataFrame(list(pairs), columns=["a", "b"])

    def joined(batches):
        held, seen = None, set()  # the last bucket of a batch may go on in the next
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.empty(0, bool)
            held = rows[last]
            if len(held) < len(rows):
                yield compare(rows[~last].reset_index(drop=True), seen)
        if held is not None and len(held):
            yield compare(held.reset_index(drop=True), seen)

    return ordered.mapInPandas(joined, "a binary, b binary").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Return (id, text_hash, fingerprint binary, component_id, first) for each row.

    Links join documents whose sets of ``words``-word shingles have an estimated Jaccard
    similarity of at least ``similarity``; a pair at that similarity shares a segment with
    probability ``RECALL``, and closer ones with more. Words are lower-cased and parted by
    white space; a document of fewer words is one shingle, and all without words are equal.
    Ids, nulls and repeated rows are treated as in ``near_duplicates``.
    """
    bits, number, width = segments_for(docs.count(), similarity)
    texts = docs.select(F.col(id_col).alias("id"), hash_of(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def make():
        hashed = Hasher()
        return lambda batch: [[wide_fingerprint(shingle_hashes(hashed(t or ""), words), width).tobytes() for t in batch]]

    found = cut(by_column(texts, "text", make, "fingerprint binary"))
    return components_of(found, lambda distinct: wide_links(distinct, similarity, bits, number)).withColumnRenamed("id", id_col)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of similar documents, its first; of equal rows, one stays."""
    found = similar_documents(docs, id_col, text_col, words, similarity).where("first")
    key, kept, own = fresh(docs, "id", "kept", "hash")
    rows = cut(found.groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(kept)).agg(F.count(F.lit(1)).alias("n")))
    hashed = docs.withColumn(own, hash_of(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & F.col(own).eqNullSafe(F.col(kept))
    out = hashed.join(rows.where("n = 1"), same, "left_semi")
    repeated = rows.where("n > 1")
    if not repeated.isEmpty():  # only these texts are shuffled again
        out = out.union(hashed.join(repeated, same, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)


def hexadecimal(fingerprint: Column) -> Column:
    """16 lower-case hex digits of a bigint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
