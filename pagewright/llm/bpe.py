"""What the byte-level BPE operators share: vocabulary files and an exact slow merge."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache


def rank_file(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(1)
def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves; the others follow, in
    order, from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def json_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by token bytes, and ids of added tokens, of a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    added = {x["content"]: x["id"] for x in said["added_tokens"]}
    stand = printable_bytes()
    return {bytes(map(stand.__getitem__, t)): i for t, i in said["model"]["vocab"].items() if t not in added}, added


@lru_cache(2)
def ranked_by_id(path: str) -> bool:
    """Whether a tokenizer's JSON file lists its merges in the order of the ids they make, so that ids serve as ranks."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:], strict=False))


def merge(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[int]:
    """Ids of one piece by ranked merges, lowest rank first, then leftmost; O(n log n). Only ranks ``below`` are merged."""
    end = len(piece)
    after = list(range(1, end + 1))  # where the part that starts here ends
    before = list(range(-1, end))
    alive = bytearray(b"\1") * end
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if after[at] < end:
            stop = after[after[at]]
            rank = ranks.get(piece[at:stop])
            if rank is not None and rank < below:
                heapq.heappush(heap, (rank, at, stop))

    for i in range(end - 1):
        offer(i)
    while heap:
        _, at, stop = heapq.heappop(heap)
        if not alive[at] or after[at] >= end or after[after[at]] != stop:
            continue
        gone = after[at]
        alive[gone] = 0
        after[at] = stop
        if stop < end:
            before[stop] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, i = [], 0
    while i < end:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out
