"""Hierarchical packing of token ids into sequences of several context sizes.

Documents are cut into full windows of the longest context; the rest of each is routed to the shortest context
that holds it. Contexts are packed from the longest to the shortest: what a window leaves open is filled with the
largest rests that fit, from its own and the shorter contexts, and when none fits, with the head of a longer one.
So every window is full until the rests run out, and the rest of a task's last window is cut into sequences whose
lengths are powers of two. Windows are dealt to step groups of equal numbers of tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .registry import query
from .tables import documents
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 1 << 16
CHUNK_TOKENS = 1 << 20


class Rests:
    """Rests of documents (document, start) by length; finds the longest that fits and the shortest that does not."""

    def __init__(self, longest: int):
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0  # bit n: there is a rest of n ids

    def add(self, length: int, doc: int, start: int) -> None:
        if length:
            self.stacks[length].append((doc, start))
            self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        stack = self.stacks[length]
        found = stack.pop()
        if not stack:
            self.mask &= ~(1 << length)
        return found

    def fitting(self, room: int) -> int:
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1

    def beyond(self, room: int) -> int:
        above = self.mask >> (room + 1)
        return room + (above & -above).bit_length() if above else 0


def fill_window(rests: Rests, size: int) -> list[tuple[int, int, int]]:
    """Pieces (document, start, length) for one window: whole rests, largest first, then the head of another one."""
    pieces, room = [], size
    while room and rests.mask:
        length = rests.fitting(room)
        if length > 0:
            pieces.append((*rests.take(length), length))
            room -= length
        else:
            length = rests.beyond(room)
            doc, start = rests.take(length)
            pieces.append((doc, start, room))
            rests.add(length - room, doc, start + room)
            room = 0
    return pieces


def pack(rests: Rests, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Full windows (size, pieces), longest context first. Rests of fewer ids than the shortest context remain."""
    for i in range(len(tiers) - 1, -1, -1):
        size, shorter = tiers[i], tiers[i - 1] if i else 0
        while rests.mask >> (shorter + 1):  # a rest that is too long for the next shorter context
            pieces = fill_window(rests, size)
            if sum(p[2] for p in pieces) < size:
                for doc, start, length in pieces:
                    rests.add(length, doc, start)
                break
            yield size, pieces
        if sum(n * len(s) for n, s in enumerate(rests.stacks) if s) < tiers[0]:
            return


def close(rests: Rests, largest: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """What is left, in sequences whose lengths are powers of two."""
    left = sum(n * len(s) for n, s in enumerate(rests.stacks) if s)
    while left:
        size = min(largest, 1 << (left.bit_length() - 1))
        yield size, fill_window(rests, size)
        left -= size


def _pack_task(tokenizer: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, chunk_tokens: int):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
    longest = tiers[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, "dropped"), np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        docs: dict[int, tuple[int | None, bytes]] = {}
        rests = Rests(longest)
        waiting: dict[int, list[list[tuple]]] = {}
        rows: list[tuple] = []
        number = sequences = groups = held = 0

        def emit(size: int, pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequences, groups
            offset, window = 0, []
            for doc, start, length in pieces:
                key, ids = docs[doc]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                window.append((key, start, length, crc, len(ids) // 4, base + sequences, offset, size))
                offset += length
            sequences += 1
            group = waiting.setdefault(size, [])
            group.append(window)
            if len(group) * size >= step_tokens:
                rows.extend(r + (base + groups,) for w in waiting.pop(size) for r in w)
                groups += 1

        def drain() -> pd.DataFrame:
            nonlocal rows
            out, rows = pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"}), []
            return out

        for batch in batches:
            for key, ids in zip(batch["doc_id"], encode.encode_all(batch["text"])):
                ids += end
                docs[number] = (None if pd.isna(key) else int(key), ids)
                n, start = len(ids) // 4, 0
                while n - start > longest:
                    emit(longest, [(number, start, longest)])
                    start += longest
                rests.add(n - start, number, start)
                number, held = number + 1, held + n
                if held >= chunk_tokens:
                    for size, pieces in pack(rests, tiers):
                        emit(size, pieces)
                    alive = {doc for stack in rests.stacks for doc, _ in stack}
                    docs = {k: v for k, v in docs.items() if k in alive}
                    held = 0
                    yield drain()
        for size, pieces in pack(rests, tiers):
            emit(size, pieces)
        for size, pieces in close(rests, longest):
            emit(size, pieces)
        # Contexts are powers of two: taken from the longest down they fill a step group exactly.
        filled = 0
        for size in sorted(waiting, reverse=True):
            for window in waiting[size]:
                rows.extend(r + (base + groups,) for r in window)
                filled += size
                if filled >= step_tokens:
                    groups, filled = groups + 1, 0
        yield drain()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group), one row per piece.

    ``tiers`` are powers of two, ascending; ``tokenizer`` is the path of a BPE file with word ends that every
    machine has. Each id of each row, ``end_id`` included, lies in exactly one piece. Every sequence is exactly as
    long as its context, a power of two; those shorter than the shortest tier are the last of a task and hold
    what no window could take. A step group has ``step_tokens`` ids, the last of each task fewer. A null text
    counts as empty and gives one id; repeated rows are packed each; an empty table gives no rows; other columns
    are ignored. Nothing is shuffled: a task packs what it reads, ``chunk_tokens`` ids at a time.
    """
    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, context int, step_group bigint"
    )
    return docs.select("doc_id", "text").mapInPandas(_pack_task(tokenizer, end_id, tiers, step_tokens, chunk_tokens), schema)


@query("op4_hierarchical_packing")
def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
