"""Hierarchical packing of token sequences into several context sizes.

Documents are routed to the smallest context size that holds them; what is longer than
the largest size is first cut into whole windows of it. Windows of a long size take
one document of their own size and fill the gap with the best fitting documents of
the shorter sizes, and the last gap with a cut piece, so that every window is full.
Windows are dealt to step groups of near equal numbers of tokens.

Each input partition packs its own rows as a stream of pools, without any shuffle; what
doesn't fill a window waits for the next pool. Only the tail of a partition is left
over: it is cut into windows of powers of two, and less than ``SHORTEST`` tokens of a
partition are padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import json_vocabulary, ranked_by_id
from .common import bounded_batches

#: Context sizes; the largest is the sequence length.
TIERS = (256, 512, 1024, 2048)
#: Tokens that are packed together, and tokens of a step group.
POOL, STEP = 64 * 2048, 8 * 2048
SHORTEST = 64
PIECES = (
    "{id} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, "
    "sequence_tokens bigint, tier int, step_group bigint"
)


def tokenizer(path: str):
    """A function from a text to its ids (uint32) by the vocabulary of a tokenizers JSON file.

    The merges are done by tiktoken, several times as fast on the same vocabulary; texts
    that hold an added token (a literal ``<|endoftext|>``) get its id, as in tokenizers.
    """
    import public_tokenizers
    import tiktoken

    ranks, added = json_vocabulary(path)
    if not ranked_by_id(path):
        raise ValueError("the vocabulary's merges aren't in the order of their tokens' ids")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    marks = tuple(added)

    def ids(text: str) -> np.ndarray:
        special = "all" if any(m in text for m in marks) else set()
        return coder.encode_to_numpy(text, allowed_special=special, disallowed_special=())

    return ids


class Packer:
    """Packs one stream of documents."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.waiting: list[list[tuple]] = [[] for _ in tiers]  # by tier: (length, document, start)
        self.tokens = 0

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list[tuple]]]:
        """Cut whole windows off a long document and route the rest."""
        top, start = self.tiers[-1], 0
        while n - start >= top:
            yield top, [(doc, start, top)]
            start += top
        if start < n:
            self._wait(doc, start, n - start)

    def _wait(self, doc: int, start: int, n: int) -> None:
        tier = next(i for i, t in enumerate(self.tiers) if n <= t)
        insort(self.waiting[tier], (n, doc, start))
        self.tokens += n

    def _largest(self, tiers: range, most: int) -> tuple | None:
        """Take the longest waiting document of at most ``most`` tokens."""
        for t in tiers:
            if at := bisect_right(self.waiting[t], (most, float("inf"), 0)):
                return self.waiting[t].pop(at - 1)
        return None

    def windows(self, flush: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Full windows from what waits; with ``flush``, windows of powers of two to the end."""
        for tier in reversed(range(len(self.tiers))):
            size = self.tiers[tier]
            while self.waiting[tier] and self.tokens >= size:
                yield size, self._fill(size, tier)
        if flush:
            size = self.tiers[-1]
            while self.tokens:
                while size > self.tokens and size > SHORTEST:
                    size //= 2
                yield size, self._fill(min(size, self.tokens), len(self.tiers) - 1)

    def _fill(self, size: int, tier: int) -> list[tuple]:
        """One window: best fits from this tier down, then a cut piece of the longest that waits."""
        pieces, gap = [], size
        down = range(tier, -1, -1)
        while gap:
            took = self._largest(down, gap)
            if took is None:
                took = next(self.waiting[t].pop() for t in reversed(range(len(self.tiers))) if self.waiting[t])
            n, doc, start = took
            self.tokens -= n
            pieces.append((doc, start, min(n, gap)))
            if n > gap:
                self._wait(doc, start + gap, n - gap)
            gap -= min(n, gap)
        return pieces


def step_groups(windows: list[tuple[int, list[tuple]]], step: int) -> list[int]:
    """Deal windows to groups: longest first, each to the group with the fewest tokens."""
    load = [0] * max(1, round(sum(n for n, _ in windows) / step))
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        out[i] = load.index(min(load))
        load[out[i]] += windows[i][0]
    return out


def pack(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, by: str | None = None) -> DataFrame:
    """Return a row per piece: its place in the document and in its sequence.

    A null text counts as empty: the document is its end token alone. Rows that repeat an
    id, and nulls in the id, are documents of their own. An empty table gives no pieces.
    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    sequence's tokens, its tier (the padded length) and its step group. With ``by``, a string
    column, a sequence and a step group have documents of one value of it (null is one, too),
    and it is the last column.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(by) if by else F.lit(None)).cast("string").alias("by"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)
        encode = tokenizer(path)
        number = group_number = TaskContext.get().partitionId() << 32
        packers: dict[str | None, Packer] = {}
        ready: dict[str | None, list[tuple[int, list[tuple]]]] = {}
        held: dict[int, tuple] = {}  # documents with pieces to come: id, ids, tokens that are left
        count = 0

        def emit(value: str | None) -> pa.RecordBatch:
            nonlocal number, group_number
            rows = []
            groups = step_groups(ready[value], STEP)
            for (size, pieces), group in zip(ready[value], groups, strict=True):
                offset, total = 0, sum(p[2] for p in pieces)
                tier = size if size == total else tiers[-1]
                for doc, start, n in pieces:
                    name, ids, left = held[doc]
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    rows.append((name, start, n, crc, len(ids), number, offset, total, tier, group_number + group, value)[: len(names)])
                    offset += n
                    if left == n:
                        del held[doc]
                    else:
                        held[doc] = (name, ids, left - n)
                number += 1
            group_number += max(groups, default=-1) + 1
            ready[value].clear()
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names, strict=True)], schema=names)

        for batch in batches:
            for name, text, value in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "by")), strict=True):
                if value not in packers:
                    packers[value], ready[value] = Packer(tiers), []
                packer = packers[value]
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                held[count] = (name, ids, len(ids))
                ready[value].extend(packer.add(count, len(ids)))
                count += 1
                if packer.tokens >= POOL:
                    ready[value].extend(packer.windows())
                if len(ready[value]) >= 4 * POOL // tiers[-1]:
                    yield emit(value)
        for value, packer in packers.items():
            ready[value].extend(packer.windows(flush=True))
            yield emit(value)

    schema = StructType.fromDDL(PIECES.format(id="id", kind=kind) + ", `by` string" * bool(by))
    packed = texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return packed.withColumnRenamed("by", by) if by else packed
