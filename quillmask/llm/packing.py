"""Packing documents into sequences by a linear grouping scheme.

1. Pieces longer than an eighth of a sequence are *large*.  Sorted by length
   they form groups of equal cardinality; each length counts as the largest of
   its group.
2. With that few sizes, the configurations (how many of each size fill a
   sequence) are optimised by the configuration linear program, solved by
   column generation; its solution is rounded down and what is left over is
   packed first-fit decreasing.
3. The actual pieces take the places of their group.
4. The small pieces go, longest first, into the sequence of least sufficient
   actual room (best fit), and into new sequences if there is none.

Only counts reach the driver: a histogram of lengths, and one of the room left
(both of at most ``capacity`` entries, whatever the input).  Steps 1, 2 and 4
work on counts: a piece is known by its length and its rank among pieces of
that length, a sequence by its room and its rank among those; places are
ranges of ranks.  Ranks are numbered inside partitions and offset by the
counts of earlier partitions, so no length is gathered in one task.

Defined results: a null or empty text is a piece of one token; repeated rows
are documents of their own; no documents give no pieces.
"""
from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, prepared, stored
from .tokens import CACHE_BYTES, CHUNK, TOKENIZER, encoder, release

CAPACITY = 2048
GROUPS = 96
END = b"\0\0\0\0"               # id 0 ends a document
SHIFT = 40                      # (class, rank) as one integer
BROADCAST_ROWS = 500_000
DOCS = 1024                     # documents encoded together
PIECE = pa.schema([("doc_id", pa.string()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "part", "nth"))])


class Numbers:
    """``part`` and ``nth`` of a task's rows: its partition, and 0, 1, ...
    among its rows of equal ``by``."""

    def __init__(self, by: str):
        self.by, self.seen, self.part = by, Counter(), TaskContext.get().partitionId()

    def added(self, pdf: pd.DataFrame) -> pd.DataFrame:
        nth = pdf.groupby(self.by).cumcount() + pdf[self.by].map(lambda v: self.seen[v])
        self.seen.update(pdf[self.by].value_counts().to_dict())
        return pdf.assign(part=self.part, nth=nth.astype("int64"))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` written, with ``rank``: 0, 1, ... among the rows of equal ``by``."""
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(by)
        for pdf in batches:
            yield numbers.added(pdf)

    rows = stored(df.mapInPandas(number, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, part long, nth long"), name)
    return ranked(rows, by)


def ranked(rows: DataFrame, by: str) -> DataFrame:
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))
                  .select(by, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "ranks")
    base = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
    return rows.join(base, [by, "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, *tokenizer, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and rank of every piece.  They
    are numbered where they are made, so a task has one worker."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, numbers = encoder(*tokenizer), Numbers("length")
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part, rows = batch.slice(at, DOCS).to_pydict(), []
                for doc, ids in zip(part["doc_id"], coder.encode(part["text"])):
                    ids = memoryview(ids + END)
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[b:b + 4 * capacity]
                        rows.append((doc, k, b // 4, len(own) // 4, zlib.crc32(own)))
                made = numbers.added(pd.DataFrame(rows, columns=PIECE.names[:5]))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type, from_pandas=f.name == "doc_id") for f in PIECE], schema=PIECE)
            give_back()
        if not keep:
            del coder                   # or it is alive when the worker's memory is given back
            release()

    kind = docs.schema[doc_id].dataType.simpleString()
    # as text: ids of any type
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(read.mapInArrow(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, part long, nth long"), "pieces")
    return ranked(rows, "length").withColumn("doc_id", F.col("doc_id").cast(kind))


def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of largest total value that fits (each size is
    over an eighth of the capacity, so few fit): by number of items."""
    use = np.flatnonzero(value > 1e-12)
    if not len(use):
        return np.zeros(len(size), dtype=np.int64)
    # best[room] with one more item each turn; below the least room: nothing fits
    before = np.arange(capacity + 1)[None, :] - size[use][:, None]
    fits, before = before >= 0, np.maximum(before, 0)
    best, choice = np.zeros(capacity + 1), []
    while True:
        gain = np.where(fits, best[before] + value[use][:, None], -1.0)
        top = gain.argmax(axis=0)
        better = gain[top, np.arange(capacity + 1)] > best + 1e-12
        if not better.any():
            break
        choice.append(np.where(better, use[top], -1))
        best = np.where(better, gain[top, np.arange(capacity + 1)], best)
    out, room = np.zeros(len(size), dtype=np.int64), capacity
    for pick in reversed(choice):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= size[pick[room]]
    return out


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, turns: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often) to cover the demand: the
    configuration program by column generation, rounded down, and first-fit
    decreasing for the rest.  Every column improves; ``turns`` only bounds the
    time on degenerate programs."""
    g = len(size)
    if not g:
        return []
    basis = np.diag(capacity // size).astype(float)
    for _ in range(turns):
        dual = np.linalg.solve(basis.T, np.ones(g))
        pattern = best_pattern(dual, size, capacity)
        if dual @ pattern <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    x = np.linalg.solve(basis, demand.astype(float))
    out, left = [], demand.copy()
    for j in np.argsort(-x):
        often = int(np.floor(max(x[j], 0) + 1e-9))
        column = basis[:, j].round().astype(np.int64)
        if often:
            out.append((column, often))
            left -= column * often
    left = np.maximum(left, 0)
    rest: list[list] = []               # room, column
    for j in np.argsort(-size):
        for _ in range(int(left[j])):
            bin_ = next((b for b in rest if b[0] >= size[j]), None)
            if bin_ is None:
                bin_ = [capacity, np.zeros(g, dtype=np.int64)]
                rest.append(bin_)
            bin_[0] -= size[j]
            bin_[1][j] += 1
    return out + [(b[1], 1) for b in rest]


class LargePlan:
    """Place of a large piece: its position among the large ones, longest
    first, gives its group; its position in the group, a configuration, a copy
    of it, and a slot."""

    def __init__(self, counts: dict[int, int], capacity: int, n_groups: int = GROUPS):
        self.full = counts.get(capacity, 0)
        lengths = sorted((s for s in counts if s < capacity), reverse=True)
        n = np.array([counts[s] for s in lengths], dtype=np.int64)
        self.before = np.zeros(capacity + 1, dtype=np.int64)
        self.before[lengths] = np.cumsum(n) - n
        total = int(n.sum())
        each = max(1, -(-total // n_groups))
        ends = np.cumsum(n)
        first = [lengths[int(np.searchsorted(ends, at, side="right"))] for at in range(0, total, each)]
        # groups of one size are one group
        starts = [k * each for k, s in enumerate(first) if k == 0 or s != first[k - 1]]
        self.size = np.array([s for k, s in enumerate(first) if k == 0 or s != first[k - 1]], dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        demand = np.diff(np.append(self.starts, total))
        key, seq, width, slot = [], [], [], []
        base, self.used = self.full, configurations(self.size, demand, capacity)
        covered = np.zeros(len(self.size), dtype=np.int64)
        for column, often in self.used:
            at = 0
            for j in np.flatnonzero(column):
                key.append((int(j) << SHIFT) + int(covered[j]))
                seq.append(base)
                width.append(int(column[j]))
                slot.append(at)
                covered[j] += column[j] * often
                at += int(column[j])
            base += often
        order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
        self.key, self.seq, self.width, self.slot = (np.array(v, dtype=np.int64)[order] for v in (key, seq, width, slot))
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of pieces."""
        seq, slot = rank.copy(), np.zeros(len(rank), dtype=np.int64)
        part = length < capacity
        if part.any():
            at = self.before[length[part]] + rank[part]
            j = np.searchsorted(self.starts, at, side="right") - 1
            key = (j << SHIFT) + at - self.starts[j]
            k = np.searchsorted(self.key, key, side="right") - 1
            nth = key - self.key[k]
            seq[part], slot[part] = self.seq[k] + nth // self.width[k], self.slot[k] + nth % self.width[k]
        return seq, slot


class SmallPlan:
    """Best fit decreasing on counts.  A move: pieces of a length, ranks from
    ``key`` on, go one each into the sequences of a room class, ranks from
    ``first`` on; class -1 are the new sequences."""

    def __init__(self, counts: dict[int, int], rooms: dict[int, int], capacity: int):
        runs: dict[int, list] = defaultdict(list)
        for room, n in rooms.items():
            if room:
                runs[room].append((room, 0, n))
        open_ = sorted(runs)
        moves, self.new = [], 0
        for length in sorted(counts, reverse=True):
            left, rank = counts[length], 0
            while left:
                k = bisect.bisect_left(open_, length)
                if k == len(open_):
                    n = -(-left // (capacity // length))
                    runs[capacity].append((-1, self.new, n))
                    self.new += n
                    bisect.insort(open_, capacity)
                    continue
                room = open_[k]
                of, first, n = runs[room].pop()
                take = min(n, left)
                if take < n:
                    runs[room].append((of, first + take, n - take))
                if not runs[room]:
                    open_.pop(k)
                moves.append(((length << SHIFT) + rank, of, first))
                rank, left, rest = rank + take, left - take, room - length
                if rest:
                    if not runs[rest]:
                        bisect.insort(open_, rest)
                    runs[rest].append((of, first, take))
        self.key, self.of, self.first = (np.array(v, dtype=np.int64) for v in zip(*sorted(moves))) if moves else (np.zeros(0, np.int64),) * 3

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Room class and rank in it of the sequence of each piece."""
        key = (length << SHIFT) + rank
        k = np.searchsorted(self.key, key, side="right") - 1
        return self.of[k], self.first[k] + key - self.key[k]


def histogram(df: DataFrame, by: str) -> dict[int, int]:
    """At most ``capacity`` entries."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         n_groups: int = GROUPS, tokenizer: str = TOKENIZER, cache_bytes: int = CACHE_BYTES, chunk: int = CHUNK,
         keep: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  ``cache_bytes`` and ``chunk`` trade a worker's memory for speed;
    without ``keep``, a worker lets its tokenizer go after each task."""
    spark = prepared(docs.sparkSession)
    rows = pieces(docs, doc_id, text, capacity, tokenizer, cache_bytes, chunk, keep=keep)
    counts = histogram(rows, "length")
    limit = capacity // 8
    large = LargePlan({s: n for s, n in counts.items() if s > limit}, capacity, n_groups)
    held = spark.sparkContext.broadcast(large)

    def place_large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, slot = held.value.place(pdf["length"].to_numpy(), pdf["rank"].to_numpy(), capacity)
            yield pdf.assign(sequence_id=seq, slot=slot)

    kept = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    columns = "doc_id string, piece int, start long, length long, ids_crc32 long, rank long"
    placed = stored(kept.filter(F.col("length") > limit).mapInPandas(place_large, f"{columns}, sequence_id long, slot long"), "large")
    rooms = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    bins = numbered(rooms, "room", "rooms")
    small = SmallPlan({s: n for s, n in counts.items() if s <= limit}, histogram(bins, "room"), capacity)
    held_small = spark.sparkContext.broadcast(small)
    base = large.sequences

    def place_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of, nth = held_small.value.place(pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            yield pdf.assign(room=of, bin_rank=nth)

    filled = stored(kept.filter(F.col("length") <= limit).mapInPandas(place_small, f"{columns}, room long, bin_rank long"), "small")
    old = filled.filter("room >= 0").join(bins.select("room", F.col("rank").alias("bin_rank"), "sequence_id"), ["room", "bin_rank"])
    new = filled.filter("room < 0").withColumn("sequence_id", F.col("bin_rank") + F.lit(base))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    every = placed.select(*out, "slot").union(old.select(*out, F.lit(1 << 20).alias("slot"))).union(new.select(*out, F.lit(1 << 20).alias("slot")))
    inside = Window.partitionBy("sequence_id").orderBy("slot", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return every.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType)).select(*out, "offset")
