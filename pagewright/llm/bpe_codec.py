"""Byte-level BPE encoding and decoding.

The ranked merges run inside Spark: a partition's distinct words go through a fold
of higher-order functions over arrays of bytes, with the rank map as a literal.
Python only splits texts into words, refers to each distinct word by number, and
concatenates the binary pieces. Nothing is shuffled: a word is folded once for each
input partition, and the most frequent words of a sample are folded once for all.

Words of more than ``LONG`` bytes, for which a fold over arrays takes quadratic time,
go through the heap in :func:`bpe.merge`, with the same ids.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import merge, rank_file
from .common import bounded_batches, by_column

#: Words of more bytes than this are merged outside the fold.
LONG = 96
#: A worker starts a new dictionary at this many distinct words, and an Arrow batch has so many bytes of text: both bound its memory.
DICTIONARY, BATCH = 400_000, 2 << 20
#: Documents of the sample from which frequent words come, and how many words are taken.
#: The sample only saves work: ids don't depend on it.
SAMPLE_DOCS, SAMPLE_WORDS = 16_000, 200_000
#: Slots of each of the rank map's two tables; bits of a token id, and what stands for no rank and no id.
SLOTS, ID_BITS = 1 << 16, 17
NONE, NO_ID, EMPTY = 1 << 20, (1 << ID_BITS) - 1, 1 << 62
MIX = (0x1E3779B1, 0x15EBCA77)


def slot(key: int, which: int) -> int:
    return ((key * MIX[which]) >> 28) % SLOTS


@lru_cache(2)
def pair_tables(path: str) -> tuple[list[int], list[int], list[int]]:
    """Of two bytes, the first one's id below the pair's rank; and the rank map: pairs of ids that are merged into a token.

    A token is only ever merged from one pair: what is left of its bytes after all merges
    of lower rank. As Spark looks the keys of a map up one after another, the map is two
    tables: each pair is in its slot of one or the other (cuckoo hashing), next to its
    rank. An entry is the left id, the right id and the rank, from the high bits to the low ones.
    """
    ranks = rank_file(path)
    if max(ranks.values()) >= NO_ID:
        raise ValueError("the vocabulary has more ids than the rank map's entries hold")
    last: dict[tuple[int, int], int] = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, below=rank)
            if len(parts) == 2:  # else no text has this token
                last[parts[0], parts[1]] = rank
    tables: tuple[list[int], list[int]] = ([EMPTY] * SLOTS, [EMPTY] * SLOTS)
    for (a, b), rank in last.items():
        entry, which = ((a << ID_BITS) | b) << ID_BITS | rank, 0
        for _ in range(500):
            at = slot(entry >> ID_BITS, which)
            entry, tables[which][at] = tables[which][at], entry
            if entry == EMPTY:
                break
            which = 1 - which
        else:
            raise ValueError("the rank map's tables are too small for this vocabulary")
    of_byte = [ranks[bytes([b])] for b in range(256)]
    # Column 256 stands for the end of the word.
    pairs = [last.get((a, b), NONE) << ID_BITS | a for a in of_byte for b in [*of_byte, NO_ID]]
    return pairs, *tables


def fold_all(words: Column, path: str) -> Column:
    """Token ids of each word (array of bytes) of an array. The tables are bound once, as literals."""
    literal = lambda x: F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>")
    pairs, first, second = pair_tables(path)
    tables = F.struct(literal(pairs).alias("pairs"), literal(first).alias("first"), literal(second).alias("second"))
    return F.transform(F.array(tables), lambda t: F.transform(words, lambda w: fold(w, t)))[0]


def fold(word: Column, tables: Column) -> Column:
    """Token ids of ``word`` (array of bytes) as array<int>, by ranked merges.

    The state is one array: each part's id, below the rank of the part with the one after
    it. Its minimum is thus the pair to merge, the first place of it the leftmost such
    pair, and its high bits the merged token's id. A merge looks up the two pairs it makes.
    A part without an id stands at either end, so that every pair has a neighbour.
    """
    call = F.call_function
    long = lambda x: F.lit(x).cast("bigint")
    low, end = long(NO_ID), long(NONE << ID_BITS)
    bind = lambda value, use: F.transform(F.array(value), use)[0]

    def part(a: Column, b: Column) -> Column:
        """A part by its id and the next one's: an entry and its key agree in all but the rank's bits."""

        def of(key: Column) -> Column:
            entry = lambda table, mix: F.get(tables[table], F.shiftright(key * long(mix), 28).bitwiseAND(long(SLOTS - 1)).cast("int"))
            whole = F.shiftleft(key, ID_BITS)
            return F.shiftleft(F.least(entry("first", MIX[0]).bitwiseXOR(whole), entry("second", MIX[1]).bitwiseXOR(whole), long(NONE)), ID_BITS)

        return bind(F.shiftleft(a, ID_BITS).bitwiseOR(b), of).bitwiseOR(a)

    n = F.size(word)
    parts = F.transform(word, lambda b, i: F.get(tables["pairs"], b * 257 + F.coalesce(F.get(word, i + 1), F.lit(256))))
    edge = F.array(end.bitwiseOR(low))
    start = F.concat(edge, parts, edge)

    def merge_at(s: Column, best: Column, at: Column) -> Column:
        made = F.shiftright(best, ID_BITS)
        two = F.array(part(F.get(s, at - 2).bitwiseAND(low), made), part(made, F.get(s, at + 1).bitwiseAND(low)))
        return F.concat(F.slice(s, F.lit(1), at - 2), two, F.slice(s, at + 2, n))

    def step(s: Column, _: Column) -> Column:
        merged = lambda best: bind(call("array_position", s, best).cast("int"), lambda at: merge_at(s, best, at))
        return bind(F.array_min(s), lambda best: F.when(best >= end, s).otherwise(merged(best)))

    ids = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(low).cast("int"))
    done = F.aggregate(F.sequence(F.lit(2), n), start, step, ids)
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, ids(start)).otherwise(done)


@lru_cache(2)
def narrow(pattern: str):
    """``pattern`` for the standard library's engine, which takes half the time, on characters up to U+FFFF.

    Its classes are those of ``regex``, character by character. Only for patterns of
    nothing but these classes, plain characters, negated sets of classes and (?! ).
    """
    import re

    import regex

    every = "".join(map(chr, range(1 << 16)))

    def members(of: str) -> str:
        at = [ord(c) for c in regex.findall(of, every)]
        starts = [c for c, before in zip(at, [-2, *at], strict=False) if c != before + 1]
        ends = [c for c, after in zip(at, [*at[1:], -2], strict=True) if after != c + 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    classes = {c: members(c) for c in (r"\p{L}", r"\p{N}", r"\s")}
    token = re.compile(r"\\p\{[LN]\}|\\[sS]|\[\^(?:\\p\{[LN]\}|\\s)+\]")

    def own(found) -> str:
        text = found.group()
        if text == r"\S":
            return f"[^{classes[r'\s']}]"
        held = "".join(classes[c] for c in re.findall(r"\\p\{[LN]\}|\\s", text))
        return f"[^{held}]" if text.startswith("[") else f"[{held}]"

    return re.compile(token.sub(own, pattern))


def splitter(pattern: str):
    """A function from a text to its words, for the public pattern or another."""
    import public_tokenizers
    import regex

    whole = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return whole
    fast = narrow(pattern).findall
    return lambda text: fast(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else whole(text)


def nested(words: list[bytes]):
    """Words as an Arrow array of lists of byte values."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def slices(lists) -> list[bytes]:
    """Arrow lists of ids as little-endian uint32 bytes."""
    flat = np.asarray(lists.flatten()).astype("<u4").tobytes()
    ends = (np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)]) * 4).tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def words_of(pattern: str, path: str, frequent_words: bytes):
    """mapInArrow function: texts to numbered words, a row for each batch, with each new word once."""

    def run(batches):
        import pyarrow as pa

        split, ranks, known = splitter(pattern), None, dictionary(frequent_words)
        number: dict[str, int] = {}
        epoch = 0
        for batch in batches:
            if len(number) > DICTIONARY:
                number, epoch = {}, epoch + 1
            first, codes, words, done = len(number), [], [], []
            for text in batch.column("text").to_pylist():
                row = split(text or "")
                for w in set(row).difference(number):
                    number[w] = len(number)
                    b = w.encode("utf-8", "replace")
                    ids = known.get(b)
                    if ids is None and len(b) > LONG:
                        ranks = ranks or rank_file(path)
                        ids = np.array(merge(b, ranks), "<u4").tobytes()
                    words.append(b if ids is None else b"")
                    done.append(ids or b"")
                codes.append(np.fromiter(map(number.__getitem__, row), np.int32, len(row)).tobytes())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [one(batch.column("id")), one(pa.array(codes, pa.binary())), one(nested(words)), one(pa.array(done, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([first], pa.int32())], names=["docs", "codes", "words", "done", "first"])

    return run


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, then, fields: str) -> DataFrame:
    """Return (id, fields) per row of ``docs``: what ``then`` makes of the rows' ids, in the same Python worker."""
    bounded_batches(docs.sparkSession, BATCH)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = StructField("id", texts.schema["id"].dataType)
    known = frequent(texts, path, pattern)
    numbered = texts.mapInArrow(
        words_of(pattern, path, known), f"docs array<{own.dataType.simpleString()}>, codes array<binary>, words array<array<int>>, done array<binary>, first int"
    )
    merged = numbered.select("docs", "codes", "done", "first", fold_all(F.col("words"), path).alias("merged"))
    made = StructType.fromDDL(fields)

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        table, use = [], then()
        for batch in batches:
            for k in range(batch.num_rows):
                docs_, codes, done, merged_ = (batch.column(c)[k].values for c in ("docs", "codes", "done", "merged"))
                del table[batch.column("first")[k].as_py() :]
                table += [d or m for d, m in zip(done.to_pylist(), slices(merged_), strict=True)]
                ids = [b"".join(map(table.__getitem__, np.frombuffer(c, np.int32).tolist())) for c in codes.to_pylist()]
                arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(use(ids), made, strict=True)]
                yield pa.RecordBatch.from_arrays([docs_, *arrays], names=["id", *made.names])

    return merged.mapInArrow(assemble, StructType([own, *made]))


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """Return (id, ids binary) per row of ``docs``: the ids as little-endian uint32.

    A null or empty text has no ids. Rows that repeat an id, and null ids, each keep their
    own row. An empty table gives no rows.
    """
    return encoded(docs, id_col, text_col, path, pattern, lambda: lambda ids: [ids], "ids binary")


def dictionary(known: bytes) -> dict[bytes, bytes]:
    """Ids by word, of what ``frequent`` returns."""
    import pyarrow as pa

    out: dict[bytes, bytes] = {}
    for batch in pa.ipc.open_stream(known) if known else ():
        out.update(zip(batch.column("word").to_pylist(), slices(batch.column("ids")), strict=True))
    return out


def frequent(texts: DataFrame, path: str, pattern: str) -> bytes:
    """The ids of the most frequent words of a bounded sample of texts, as an Arrow stream: workers unpack it, the driver doesn't."""

    def count(batches):
        split, seen = splitter(pattern), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(split(text or ""))
            if len(seen) > DICTIONARY:
                seen = Counter(dict(seen.most_common(DICTIONARY // 2)))
        rows = [(w.encode("utf-8", "replace"), n) for w, n in seen.items()]
        rows = [(w, n) for w, n in rows if len(w) <= LONG]
        yield pd.DataFrame({"word": [w for w, _ in rows], "n": np.array([n for _, n in rows], np.int64)})

    total = texts.count()
    if not total:
        return b""
    share = max(1, total // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else texts
    words = sample.mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).select("word")

    def values(batches):
        import pyarrow as pa

        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), nested(words)], names=["word", "bytes"])

    parts = texts.sparkSession.sparkContext.defaultParallelism
    spelt = top.repartition(parts).mapInArrow(values, "word binary, bytes array<int>")
    folded = spelt.select("word", fold_all(F.array("bytes"), path)[0].alias("ids"))
    import pyarrow as pa

    found, sink = folded.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as stream:
        stream.write_table(found)
    return sink.getvalue().to_pybytes()


def pieces(path: str):
    """A function from the ids of rows to the bytes they stand for."""
    by_id = {i: t for t, i in rank_file(path).items()}
    table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return lambda ids: [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


def decode(ids: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``ids`` with a column of the concatenated pieces of the ids (little-endian uint32); null ids count as none."""
    table = ids.withColumn(out, F.col(ids_col))
    return by_column(table, out, lambda: lambda batch, use=pieces(path): [use([x or b"" for x in batch])], f"`{out}` binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""

    def then():
        use = pieces(path)
        return lambda ids: [ids, use(ids)]

    both = encoded(docs, "doc_id", "text", path, pattern, then, "ids binary, decoded binary")
    return both.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
