"""Best-fit packing: minimum bin slack over the histogram of piece lengths.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram of lengths,
``capacity`` numbers at most, reaches the driver. There each bin starts with the longest
length left, and a subset-sum dynamic program on a bitset finds the fullest feasible
combination over the lengths still available; the combination is removed as often as the
histogram allows. The plan, intervals of ranks within each length, is sent back, and each
piece finds its place from its length and its rank among the pieces of that length.

Defined results: a null or empty text is the end id alone; repeated rows and equal ids are
packed as rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.byte_level import encoder
from tabulon.llm.common import materialise, small_batches, table

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"

ORACLE_SQL = None

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, seen bigint"


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: full ones, and before them what is left over."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The token pieces of every document, with the partition that made each one and, for its
    length, how many pieces of that length the partition had made before it."""
    tail = np.asarray([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = encoder(tokenizer), Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + tail
                for k, (start, length) in enumerate(spans(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), made[length]), strict=True):
                        column.append(value)
                    made[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(out[:5], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())], names=[c.split()[0] for c in _PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """Multiset of lengths from counts with the largest sum up to room.

    Bit s of the set says that some combination has the sum s. Lengths go in from the
    longest; each doubling part of a length's multiplicity is one item.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in order:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, part = left - take, 2 * part
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            picked[length] += take
            total -= length * take
    return dict(picked)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of bins that hold it."""
    counts = {length: n for length, n in histogram.items() if n}
    order = sorted(counts, reverse=True)
    out: list[tuple[dict[int, int], int]] = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        rest = _fullest(counts, [x for x in order if counts[x]], capacity - longest)
        counts[longest] += 1
        combination = dict(Counter(rest) + Counter({longest: 1}))
        times = min(counts[x] // n for x, n in combination.items())
        for x, n in combination.items():
            counts[x] -= n * times
        order = [x for x in order if counts[x]]
        out.append((combination, times))
    return out


def intervals(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces of the length per sequence, first offset)."""
    out, used, sequence = [], Counter(), 0
    for combination, times in bins:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            out.append((length, used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return out


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of ``pieces`` (materialised) a sequence and an offset."""
    spark = made.sparkSession
    counts = made.groupBy("part", "length").agg(F.count("*").alias("_n"))
    before = counts.select(
        F.col("part").alias("_part"),
        F.col("length").alias("_length"),
        "_n",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("part")) - F.col("_n")).alias("_before"),
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *row in intervals(plan_bins(histogram, capacity)):
        by_length.setdefault(length, []).append(tuple(row))
    shared = spark.sparkContext.broadcast({k: np.asarray(v, dtype=np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            rank, length = (np.asarray(batch.column(k), dtype=np.int64) for k in (5, 3))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for value in np.unique(length):
                rows, at = plan[int(value)], np.flatnonzero(length == value)
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = made.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("seen") + F.col("_before")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in the packed sequences."""
    made = materialise(pieces(docs, tokenizer=tokenizer or public_tokenizers.path(TOKENIZER), capacity=capacity), "packing-pieces")
    return pack(made, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
