"""Packing documents into sequences by patterns of lengths.

Pieces are counted by length, at most ``capacity`` counts. Patterns of up to eight pieces that leave no room for another
piece are enumerated; non-negative least squares fits how often each is repeated, so that the
patterns use up the counts and leave little empty. The repeats are rounded in several ways within what is left, largest first, and the residual
counts are packed best fit decreasing, many equal pieces at a time; the plan with the fewest sequences stands. All of this works
on the counts, so its size is that of the capacity, not of the data. The plan says for the k-th piece of a length which sequence and offset it
takes; pieces are ranked within their length by slices, so a frequent length is not ordered in one task.

A document is its token ids, then id ``end``. Only longer ones are cut, into pieces of ``capacity`` tokens of which the
first may be shorter. Null and empty texts are one piece, the end id. Null ids and repeated rows are packed
like others. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.shared import stored, token_bytes

CAPACITY = 1024
END = 2
SLICE = 50_000
STEPS = 400
MOST = 8  # pieces of a pattern of two lengths
#: (what is added to repeats before they are rounded down, share of the capacity that a pattern's longest piece has at least).
#: The less is added and the more patterns go without repeats, the more is left to best fit; the last one leaves all.
ROUNDINGS = (*((more, least) for least in (0.0, 0.5, 0.75) for more in (0.0, 0.5, 1.0)), (0.0, 1.0))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids as little-endian 32-bit numbers."""
    def cut(batches):
        tokens, closing = token_bytes(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1).to_pylist()), strict=True):
                ids += closing
                n = len(ids) // 4
                head = (n - 1) % capacity + 1
                starts = [0, *range(head, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    data = ids[4 * a : 4 * b]
                    out.append((doc, piece, a, b - a, zlib.crc32(data), data))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def patterns(lengths: np.ndarray, capacity: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), three columns each: patterns of up to ``most`` pieces that leave no room for another piece.

    Pairs and triples of lengths at hand that add up to the capacity; and i pieces of one length with j of another, the
    longest at hand that fits j times. The last column repeats once or, in patterns without it, not at all.
    """
    at_hand = np.zeros(capacity + 1, bool)
    at_hand[lengths] = True
    below = np.maximum.accumulate(np.where(at_hand, np.arange(capacity + 1), 0))  # the longest at hand up to each length
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = capacity - a - b
    fits = (a >= b) & (c > 0) & (c <= b)
    a, b, c = a[fits], b[fits], c[fits]
    good = at_hand[c]
    made = [np.stack([a[good], b[good], c[good]], 1)]
    times = [np.ones((int(good.sum()), 3), int)]
    for i in range(1, most + 1):
        for j in range(most - i + 1):
            room = capacity - i * lengths
            a = lengths[room >= 0]
            b = below[room[room >= 0] // j] if j else np.zeros(len(a), int)
            fits = ((b > 0) & (b != a)) if j else np.ones(len(a), bool)
            a, b = a[fits], b[fits]
            tight = capacity - i * a - j * b < lengths[0]
            a, b = a[tight], b[tight]
            made.append(np.stack([a, b, np.zeros(len(a), int)], 1))
            times.append(np.tile([i, j, 0], (len(a), 1)))
    return np.concatenate(made), np.concatenate(times)


def fit(made: np.ndarray, times: np.ndarray, counts: np.ndarray, capacity: int, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise |A x - counts|, by accelerated projected gradient.

    What a pattern leaves empty is one more row of A, of which nothing is wanted.
    """
    size = len(counts)
    waste = (capacity - (made * times).sum(1)) / capacity

    def used(x):
        return sum(np.bincount(made[:, k], x * times[:, k], size) for k in range(3)), waste @ x

    def back(gap, empty):
        return sum(gap[made[:, k]] * times[:, k] for k in range(3)) + waste * empty

    # The largest eigenvalue of A'A by a few power steps.
    x = np.ones(len(made))
    for _ in range(20):
        x = back(*used(x))
        bound = np.linalg.norm(x)
        x /= bound
    step = 1 / (1.1 * bound)
    x = np.zeros(len(made))
    ahead, t = x, 1.0
    for _ in range(steps):
        total, empty = used(ahead)
        new = np.maximum(0, ahead - step * back(total - counts, empty))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - x)
        x = new
    return x


class Plan:
    """Slots of the pieces of each length: (first rank, first sequence, offset) of runs of equal slots."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.placed = np.zeros(capacity + 1, np.int64)
        self.runs: dict[int, list] = {}
        self.sequences = 0
        self.free: dict[int, list] = {}  # groups of equally filled sequences by what is free: (first sequence, number)

    def place(self, length: int, number: int, sequence: int, offset: int):
        self.runs.setdefault(length, []).append((int(self.placed[length]), sequence, offset))
        self.placed[length] += number
        self.left[length] -= number

    def repeat(self, parts: list[tuple[int, int]], number: int):
        """``number`` sequences of a pattern of (length, times)."""
        offset = 0
        for n, times in parts:
            for _ in range(times):
                self.place(n, number, self.sequences, offset)
                offset += n
        if offset < self.capacity:
            self.free.setdefault(self.capacity - offset, []).append((self.sequences, number))
        self.sequences += number

    def best_fit(self):
        """What is left, longest first, each into the fullest sequence that takes it, many equal pieces at a time."""
        capacity, left, free = self.capacity, self.left, self.free
        for n in range(capacity, 0, -1):
            while left[n]:
                room = min((r for r in free if r >= n and free[r]), default=None)
                if room is None:
                    # As many sequences as equal pieces need.
                    need = int(-(-left[n] // (capacity // n)))
                    free.setdefault(capacity, []).append((self.sequences, need))
                    self.sequences += need
                    room = capacity
                first, number = free[room].pop()
                take = int(min(number, left[n]))
                self.place(n, take, first, capacity - room)
                if take < number:
                    free[room].append((first + take, number - take))
                if room > n:
                    free.setdefault(room - n, []).append((first, take))

    def taken(self) -> int:
        """Sequences that hold a piece."""
        return self.sequences - sum(n for _, n in self.free.get(self.capacity, ()))


def plan(counts: np.ndarray, capacity: int) -> dict[int, tuple]:
    """Per length: (first rank, first sequence, offset) of runs of equal slots, sorted by rank.

    ``counts[n]`` pieces have length n. Piece k of a length lies in the last run whose first rank is at
    most k, in the sequence as far behind the run's first one as k is behind the first rank. Fitted repeats are rounded
    in the ways of ``ROUNDINGS``; the plan with the fewest sequences stands.
    """
    lengths = np.flatnonzero(counts[:capacity])
    made, times = patterns(lengths, capacity) if len(lengths) else (np.zeros((0, 3), int), np.zeros((0, 3), int))
    x = fit(made, times, np.append(counts[:capacity], 0).astype(float), capacity) if len(made) else np.zeros(0)
    # Longest pieces first, whose partners are few; their likeliest patterns first.
    longest = made.max(1, initial=0)
    order = np.lexsort((-x, -longest))
    best = None
    for more, least in ROUNDINGS:
        now = Plan(counts, capacity)
        if now.left[capacity]:
            now.repeat([(capacity, 1)], int(now.left[capacity]))
        wanted = np.where((x > 1e-3) & (longest >= least * capacity), np.floor(x + more), 0).astype(np.int64)
        for i in order[wanted[order] > 0]:
            parts = [(int(n), int(k)) for n, k in zip(made[i], times[i], strict=True) if k]
            number = int(min(wanted[i], *(now.left[n] // k for n, k in parts)))
            if number > 0:
                now.repeat(parts, number)
        now.best_fit()
        if best is None or now.taken() < best.taken():
            best = now
        if best.taken() * capacity < counts @ np.arange(capacity + 1) + capacity:
            break  # no plan needs fewer
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in best.runs.items()}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``made`` has doc_id, piece, start, length and ids_crc32."""
    spark = made.sparkSession
    made = stored(made, "pieces")
    counted = made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["n"]
    slices = max(1, int(counts.sum()) // SLICE)
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    cut = made.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    across = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = made.columns

    def put(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                first, sequences, offsets = runs.value[n]
                at = np.flatnonzero(length == n)
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = sequences[run] + rank[at] - first[run]
                offset[at] = offsets[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(put, schema + ", sequence_id long, offset long")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, folder: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{folder}/documents.parquet"), _tokenizer()))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    return pack(pieces(docs, _tokenizer()))
