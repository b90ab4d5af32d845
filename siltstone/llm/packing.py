"""Token ids packed into rows of fixed length, best fit in falling order of size.

Documents longer than a row are split into full rows and a rest, in order and without loss. Pieces are dealt to
shards by a hash and packed a window at a time: a window holds up to WINDOW_TOKENS tokens, so memory is bounded
whatever a shard gets. Within a window the longest piece goes first, each into the row with the least room that
still takes it; a segment tree over capacities (how many rows have room r, summed over ranges of r) finds that room
in log(length) steps. Each row comes out as one line of the id matrix, with the cumulative lengths of its segments
and the places where positions start anew.

Null texts and texts without tokens make no piece; repeated rows are packed as often as they come; a null doc_id is
carried as null. An empty table gives no rows. Other columns are unread."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WINDOW_TOKENS = 4_000_000
SCHEMA = "doc_ids array<long>, offsets array<long>, lengths array<int>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


class Capacities:
    """A segment tree over room 0 .. length: the least room of at least n that some row has."""

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1 - 1).bit_length() if length else 1
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, room: int) -> int | None:
        i = room + self.leaves
        if self.count[i]:
            return room
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; pieces in falling order of size, equal ones as they come, each into the fullest row that takes it (of equally full ones the newest)."""
    tree, rows, by_room = Capacities(length), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        room = tree.at_least(n)
        if room is None:
            row, room = len(rows), length
            rows.append([i])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
            rows[row].append(i)
        by_room.setdefault(room - n, []).append(row)
        tree.add(room - n, 1)
    return rows


def byte_pair_encoder(path: str, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids by a tiktoken rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.array(coding.encode_ordinary(t), np.uint32) for t in texts]


_encoders: dict[tuple, Callable] = {}


def encoder(make: Callable, *args) -> Callable:
    if (make, *args) not in _encoders:
        _encoders[make, *args] = make(*args)
    return _encoders[make, *args]


def pieces(df: DataFrame, length: int, make: Callable, args: tuple, end: int | None = None, text: str = "text", doc_id: str = "doc_id", kind: str = "<u4") -> DataFrame:
    """doc_id, at (offset in the document's ids), n, ids (binary of `kind`): the ids of each text, an end mark behind, cut at `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(make, *args)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                owner, at, n, raw = [], [], [], []
                for d, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if len(ids) and end is not None:
                        ids = np.append(ids, np.uint32(end))
                    for a in range(0, len(ids), length):
                        owner.append(d)
                        at.append(a)
                        n.append(min(length, len(ids) - a))
                        raw.append(ids[a : a + length].astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "at", "n", "ids"])

    return df.select(df[doc_id].cast("long"), df[text]).mapInArrow(lean(run), "doc_id long, at long, n int, ids binary")


def pack(cut: DataFrame, length: int, pad: int = 0, kind: str = "<u4") -> DataFrame:
    """Rows of the packed matrix from pieces(): columns of SCHEMA; ids has `length` ids of `kind`, padded behind n_tokens.

    cu_seqlens runs from 0 to n_tokens by segment; position_resets are the places where a segment begins; offsets
    tell where in its document each segment does, so the documents can be put together again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []
        held = 0
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        width = np.dtype(kind).itemsize
        blank = np.array([pad], kind).tobytes()

        def flush() -> pa.RecordBatch:
            rows = best_fit([p[2] for p in window], length)
            own = [[window[i] for i in r] for r in rows]
            cu = [np.concatenate([[0], np.cumsum([p[2] for p in r])]).astype(np.int32) for r in own]
            raw = [b"".join(p[3] for p in r) for r in own]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([[p[0] for p in r] for r in own], pa.list_(pa.int64())), pa.array([[p[1] for p in r] for r in own], pa.list_(pa.int64())),
                    pa.array([[p[2] for p in r] for r in own], pa.list_(pa.int32())), pa.array([c.tolist() for c in cu], pa.list_(pa.int32())), pa.array([c[:-1].tolist() for c in cu], pa.list_(pa.int32())),
                    pa.array([int(c[-1]) for c in cu], pa.int32()), pa.array([x + blank * (length - len(x) // width) for x in raw], pa.binary()),
                ],
                names,
            )

        for batch in batches:
            for p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                window.append(p)
                held += p[2]
                if held >= WINDOW_TOKENS:
                    yield flush()
                    window, held = [], 0
        if window:
            yield flush()

    # Dealt by a hash of the piece itself: no source or document fills a shard, and a lost task packs the same again.
    dealt = cut.withColumn("_h", F.xxhash64("doc_id", "at", "ids")).repartition("_h").sortWithinPartitions("_h", "doc_id", "at").drop("_h")
    return dealt.mapInArrow(lean(run), SCHEMA)
