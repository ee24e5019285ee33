"""Language-model scoring with Brown class-based bigrams.

Training texts give the count of every word. The most frequent words, and beyond them the
last three letters of a word, are the core items that exchange clustering assigns to classes:
each item in turn moves to the class that raises the mutual information of adjacent classes
most, until a sweep moves nothing. Every further word of the training texts, however rare or
long, then moves to the class that raises it most, by the classes of its own neighbours: the
frequent words first, and with them the endings beyond the core, next all others, whose
neighbours count by the class of their ending where they are rare too. A token has the
probability P(class | class before) * P(item | class) * P(word | item), each smoothed by
adding 0.5. A frequent word is an item of its own, and the last factor is 1; the rare words
of a class are one item together. A word that training does not have has no neighbours there:
it counts as one of the rare words of the class of its ending. A text starts after an end.

What reaches the driver is bounded: words with at least 1/FREQUENT_SHARE of all tokens,
endings with at least 1/ENDING_SHARE, counts of adjacent core items, and the class of each
frequent word. The frequent words are broadcast. Rare words, their counts and classes stay
distributed. Texts are put together in blocks of bounded size. The distinct rare words of each
block are dealt by word, once, with the classes beside their places; what a word's class and
count are found to be comes back to the blocks by the word's number there. A word has at most
one row a block.

Defined results: a null or empty text is an end alone; rows with equal ids are scored one by
one; with no training text every count is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import crc_bucket, discard, materialise, small_batches, table

FREQUENT_SHARE = 1 << 18
ENDING_SHARE = 1 << 12
#: Longer words are never broadcast.
FREQUENT_BYTES = 64
#: Core items that are words, core items that are endings, and classes.
WORD_ITEMS = 768
ENDING_ITEMS = 255
CLASSES = 48
SWEEPS = 10
#: Rare words whose item the driver looks up at once.
KEPT_WORDS = 200_000
#: Distinct words that a task counts before it passes its sums on.
TASK_WORDS = 500_000
#: Rows that a task passes on at once.
PASSED_ROWS = 50_000
#: Neighbours that a task holds before it passes their sums on.
TASK_NEIGHBOURS = 2_000_000
#: Bytes of the items and rare words of texts that make a block, unless one text alone has more.
BLOCK_BYTES = 12 << 20
#: Rows of rare words' neighbours that are judged together.
JUDGED_ROWS = 8192

#: The end token; no word holds a line feed.
END = b"\n"

ORACLE_SQL = None


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every distinct token, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                count.update(tokens(text))
            if len(count) > TASK_WORDS:
                yield rows()
                count.clear()
        yield rows()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-3:]


def ending_numbers(words: pa.Array, endings: pa.Array) -> np.ndarray:
    """The place of each word's ending among endings, or how many there are."""
    try:
        last = pc.utf8_slice_codeunits(words.cast(pa.string()), -3)
    except pa.ArrowInvalid:
        last = pa.array([ending(w) for w in words.to_pylist()], pa.string())
    return pc.index_in(last, value_set=endings).fill_null(len(endings)).to_numpy()


def last_letters() -> Column:
    return F.right(F.decode("word", "UTF-8"), F.lit(3))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(pairs: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float) -> int:
    """The best class of an item of class a, which is taken out of pairs.

    right and left count the classes that follow and precede it, but for itself: own times.
    """
    pairs[a] -= right
    pairs[:, a] -= left
    pairs[a, a] -= own
    was = _phi(pairs)
    # what stands before or after the item counts for its own class wherever it goes
    rows, columns = pairs.sum(1) + left, pairs.sum(0) + right
    gain = (_phi(pairs + right) - was).sum(1) + (_phi(pairs + left[:, None]) - was).sum(0)
    at = np.diagonal(pairs)
    gain += _phi(at + right + left + own) - _phi(at + right) - _phi(at + left) + _phi(at)
    gain -= _phi(rows + right.sum() + own) - _phi(rows) + _phi(columns + left.sum() + own) - _phi(columns)
    b = int(np.argmax(gain))
    return a if gain[b] <= gain[a] + 1e-9 else b


def best_classes(pairs: np.ndarray, a: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """best_class of many items at once, none of which stands next to itself; a row of right and left each."""
    at, n = np.arange(len(a)), right.sum(1)
    gain = np.zeros(right.shape)
    for p, side, across in ((pairs, right, left), (pairs.T, left, right)):
        # p[b, c] for every class b and the classes c met; only row and column a change as the item is taken out
        item, c = np.nonzero(side)
        k, own = side[item, c], a[item]
        step, of = np.unique(k, return_inverse=True)
        part = np.stack([(_phi(p + x) - _phi(p)).T for x in step])[of, c] if len(step) else np.zeros((0, len(p)))
        same = c == own
        was = p.T[own[same]] - across[item[same]]
        part[same] = _phi(was + k[same, None]) - _phi(was)
        x = p[own, c] - k - np.where(same, across[item, own], 0.0)
        part[np.arange(len(c)), own] = _phi(x + k) - _phi(x)
        if len(c):
            first = np.flatnonzero(np.diff(item, prepend=-1))
            gain[item[first]] += np.add.reduceat(part, first, axis=0)
        total, (many, of) = p.sum(1), np.unique(n, return_inverse=True)
        gain[at, a] += _phi(total[a] - n) - _phi(total[a]) + (over := _phi(total + many[:, None]) - _phi(total))[of, a]
        gain -= over[of]
    item, b = np.nonzero((right > 0) & (left > 0))
    r, f = right[item, b], left[item, b]
    d = pairs[b, b] - np.where(b == a[item], r + f, 0.0)
    gain[item, b] += _phi(d + r + f) - _phi(d + r) - _phi(d + f) + _phi(d)
    best = np.argmax(gain, 1)
    return np.where(gain[at, best] <= gain[at, a] + 1e-9, a, best)


def exchange(adjacent: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item, by exchange clustering of adjacency counts."""
    n = len(adjacent)
    adjacent = adjacent.astype(float)
    weight = adjacent.sum(0) + adjacent.sum(1)
    order = np.argsort(-weight, kind="stable")
    of = np.full(n, classes - 1)
    of[order[: classes - 1]] = np.arange(min(n, classes - 1))
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    pairs = member.T @ adjacent @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            own = adjacent[w, w]
            right = np.bincount(of, weights=adjacent[w], minlength=classes)
            left = np.bincount(of, weights=adjacent[:, w], minlength=classes)
            a = of[w]
            right[a] -= own
            left[a] -= own
            b = best_class(pairs, a, right, left, own)
            pairs[b] += right
            pairs[:, b] += left
            pairs[b, b] += own
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


class ItemOf(dict):
    """Item by word: frequent words have their own, any other one that of its class.

    The classes of rare words are a distributed table: the driver asks it for those not held yet.
    """

    words: DataFrame | None = None
    unheld = True

    def learn(self, items: Items, words: DataFrame, by_ending: np.ndarray) -> None:
        self.clear()
        self.update(items.own)
        self.items, self.words, self.by_ending, self.unheld = items, words, by_ending, True

    def __missing__(self, word: bytes) -> int:
        if self.words is None:
            raise KeyError(word)
        first = len(self.items.own)
        if self.unheld:
            self.unheld = False
            for r in self.words.orderBy(F.desc("n"), "word").limit(KEPT_WORDS).collect():
                self[bytes(r["word"])] = first + r["class"]
            return self[word]
        found = self.words.where(F.col("word") == F.lit(word)).first() if len(self) - first >= KEPT_WORDS else None
        self[word] = k = first + (found["class"] if found else int(self.by_ending[self.items.endings.get(ending(word), -1)]))
        return k


@dataclass
class Items:
    """What each token is to the model: a bounded table."""

    counts: dict[bytes, int]  # of frequent words
    own: dict[bytes, int]  # items of frequent words, the end's 0; the rare words of each class are one item beyond them
    base: int  # how many of these are core items
    endings: dict[str, int]  # numbers of endings; all others together have the next number
    core_endings: int  # how many of these are core items, next to the words; all others together are the last one
    core: np.ndarray  # core item of each frequent word: of one beyond the core, that of its ending
    total: int
    distinct: int
    item: ItemOf = field(default_factory=ItemOf)
    classes: int = 0

    def __len__(self) -> int:
        return len(self.own) + self.classes

    def of_endings(self) -> np.ndarray:
        """The core item of each ending."""
        return self.base + np.minimum(np.arange(len(self.endings) + 1), self.core_endings)

    def own_counts(self) -> np.ndarray:
        return np.array([self.counts[w] for w in self.own], dtype=float)


def choose_items(counts: DataFrame) -> Items:
    """Items from the materialised counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    many = counts.where((F.col("n") * FREQUENT_SHARE >= total) & (F.octet_length("word") <= FREQUENT_BYTES) | (F.col("word") == F.lit(END)))
    known = {END: 0} | {bytes(r["word"]): r["n"] for r in many.collect()}
    words = [END, *sorted((w for w in known if w != END), key=lambda w: (-known[w], w))]
    base = min(len(words), WORD_ITEMS + 1)
    tail = counts.where(F.col("word") != F.lit(END)).groupBy(last_letters().alias("ending")).agg(F.sum("n").alias("n"))
    left = {r["ending"]: r["n"] for r in tail.where(F.col("n") * ENDING_SHARE >= total).collect()}
    for w in words[1:base]:
        if (e := ending(w)) in left:
            left[e] -= known[w]
    endings = {e: k for k, e in enumerate(sorted(left, key=lambda e: (-left[e], e)))}
    core_endings = min(sum(n > 0 for n in left.values()), ENDING_ITEMS)
    beyond = [base + min(endings.get(ending(w), len(endings)), core_endings) for w in words[base:]]
    core = np.array([*range(base), *beyond], dtype=np.int64)
    return Items({w: known[w] for w in words}, {w: k for k, w in enumerate(words)}, base, endings, core_endings, core, total, distinct)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones and so on: that packs better than whole numbers."""
    return np.ascontiguousarray(numbers).view("u1").reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(size, -1).T).view(kind).ravel()


_BLOCK = "block bigint, doc_id array<bigint>, scored array<boolean>, trained array<boolean>, n array<int>, items binary, words array<binary>, endings binary"
_TRAINED = ("trained", "n", "items", "endings")
_TEXTS = ("block", "doc_id", "scored", "trained", "n")
_NEAR = ["word", "seen", "block", "number"]
#: A rare word's number in a block.
_PLACE = np.dtype([("block", "<i8"), ("number", "<i4")])


def item_rows(docs: DataFrame, items: Items) -> DataFrame:
    """Blocks of texts, each with the distinct rare words of its texts and, as 16-bit numbers, the endings of these.

    doc_id, scored, trained and n (tokens) have an entry for each text; items are those of all tokens in order, as 32-bit
    numbers in planes, and -1 - k for the block's rare word k. docs has doc_id, text, and whether a row is scored and trained on.
    """
    shared = docs.sparkSession.sparkContext.broadcast((items.own, items.endings))
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, endings = shared.value
        numbers = pa.array(list(endings), pa.string())
        at, size = TaskContext.get().partitionId() << 32, 0
        texts: list[tuple] = []
        found: list[np.ndarray] = []
        rare: list[bytes] = []

        def block() -> pa.RecordBatch:
            words = pa.array(rare, pa.binary()).dictionary_encode()
            ids = np.concatenate(found)
            ids[ids < 0] = -1 - words.indices.to_numpy()
            ends = ending_numbers(words.dictionary, numbers).astype("<u2").tobytes()
            each = [pa.array([list(x)], pa.list_(kind)) for x, kind in zip(zip(*texts, strict=True), (pa.int64(), pa.bool_(), pa.bool_(), pa.int32()), strict=True)]
            own_words = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
            for x in (texts, found, rare):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *each, pa.array([planes(ids)], pa.binary()), own_words, pa.array([ends], pa.binary())], names=names)

        for batch in batches:
            for *text, t in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                words = tokens(t)
                ids = np.fromiter(map(own.get, words, repeat(-1)), dtype="<i4", count=len(words))
                texts.append((*text, len(words)))
                found.append(ids)
                more = [words[k] for k in np.flatnonzero(ids < 0).tolist()]
                rare += more
                size += 64 + 4 * len(words) + sum(map(len, more))
                if size > BLOCK_BYTES:
                    yield block()
                    at, size = at + 1, 0
        if texts:
            yield block()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "scored", "trained", "text").mapInArrow(run, _BLOCK)


def keep_blocks(rows: DataFrame) -> DataFrame:
    """materialise, with few blocks at once in memory."""
    return materialise(rows, "lm-rows", **{"parquet.block.size": 2 * BLOCK_BYTES, "parquet.page.size.row.check.min": 1})


def unpack(batch: pa.RecordBatch, every: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's place in the batch, and the items of its texts that are trained on, or of all, after an end.

    Then the places of rare words among them, these words' numbers in the block and their endings.
    """
    for k in range(len(batch)):
        row = from_planes(batch.column("items")[k].as_py(), "<i4")
        if not every:
            trained = np.array(batch.column("trained")[k].as_py(), dtype=bool)
            row = row[np.repeat(trained, batch.column("n")[k].values.to_numpy())]
        row = np.concatenate(([0], row)).astype(np.int64)
        rare = np.flatnonzero(row < 0)
        number = -1 - row[rare]
        row[rare] = 0
        yield k, row, rare, number, np.frombuffer(batch.column("endings")[k].as_py(), dtype="<u2").astype(np.int64)[number]


def counted(rows: DataFrame, codes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], hold: int = TASK_NEIGHBOURS) -> DataFrame:
    """(code, n) of the codes that batches give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sums() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for found in codes(batch):
                held.append(found)
                if sum(map(len, held)) > hold:
                    yield sums()
        yield sums()

    return rows.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def matrix(found: DataFrame, size: int) -> np.ndarray:
    got = found.toPandas()
    out = np.zeros(size * size, dtype=np.int64)
    out[got["code"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out.reshape(size, size)


def adjacency(rows: DataFrame, own: np.ndarray, by_ending: np.ndarray, size: int) -> np.ndarray:
    """Counts of adjacent numbers below size, one of each frequent word and one of each ending of rare words."""
    shared = rows.sparkSession.sparkContext.broadcast((own, by_ending))

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        own, by_ending = shared.value
        for _, row, rare, _, ends in unpack(batch):
            at = own[row]
            at[rare] = by_ending[ends]
            yield at[:-1] * size + at[1:]

    return matrix(counted(rows.select(*_TRAINED), codes), size)


def assign(rows: DataFrame, items: Items, start: np.ndarray, by_ending: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every frequent word and ending: of one beyond the core, the best one by the classes of its neighbours."""
    classes, own = len(pairs), len(start)
    start = np.concatenate((start, by_ending))
    # the last number is that of all other endings
    moves = np.ones(len(start), dtype=bool)
    moves[: items.base] = moves[own : own + items.core_endings] = moves[-1] = False
    if not moves.any():
        return start[:own], start[own:]
    slots = 2 * classes + 1  # classes after, classes before, itself
    shared = rows.sparkSession.sparkContext.broadcast((start, moves, pairs.astype(float)))

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, row, rare, _, ends in unpack(batch):
            row[rare] = own + ends
            at, moved = shared.value[0][row], shared.value[1][row]
            a, b = row[:-1], row[1:]
            same = a == b
            after, before, self_ = moved[:-1] & ~same, moved[1:] & ~same, moved[:-1] & same
            yield np.concatenate((a[after] * slots + at[1:][after], b[before] * slots + classes + at[:-1][before], a[self_] * slots + 2 * classes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, _, pairs = shared.value
        for batch in batches:
            words, best = batch.column(0).to_pylist(), []
            for w, seen in zip(words, batch.column(1).to_pylist(), strict=True):
                n = np.zeros(slots)
                n[[x["slot"] for x in seen]] = [x["n"] for x in seen]
                best.append(best_class(pairs.copy(), int(start[w]), n[:classes], n[classes:-1], n[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int64())], names=["item", "class"])

    met = counted(rows.select(*_TRAINED), codes).select(F.expr(f"code DIV {slots}").alias("item"), F.struct((F.col("code") % slots).alias("slot"), "n").alias("seen"))
    found = met.groupBy("item").agg(F.collect_list("seen").alias("seen")).mapInArrow(judge, "item bigint, class bigint").toPandas()
    out = start.copy()
    out[found["item"].to_numpy(dtype=np.int64)] = found["class"].to_numpy(dtype=np.int64)
    return out[:own], out[own:]


def number_type(classes: int) -> np.dtype:
    """Of a class, or a class of a rare word."""
    return np.dtype("u1" if classes <= 128 else "<u2")


def _joined(parts: list[np.ndarray], offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(np.concatenate(parts))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)])


def rare_neighbours(rows: DataFrame, own: np.ndarray, by_ending: np.ndarray, classes: int) -> DataFrame:
    """(word, seen, block, number) of each block's rare words: the class before and after each of a word's places in texts that are trained on, or `classes` for the word itself."""
    kind = number_type(classes)
    shared = rows.sparkSession.sparkContext.broadcast((own, by_ending))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_ending = shared.value
        for batch in batches:
            for k, row, rare, number, ends in unpack(batch):
                words, block = batch.column("words")[k].values, batch.column("block")[k].as_py()
                at = own[row]
                at[rare] = by_ending[ends]
                before, after = at[rare - 1], at[rare + 1]
                twice = np.flatnonzero((np.diff(rare) == 1) & (np.diff(number) == 0))
                after[twice] = before[twice + 1] = classes
                seen = np.column_stack((before, after)).astype(kind)[np.argsort(number, kind="stable")]
                place = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(words)))))
                for i in range(0, len(words), PASSED_ROWS):
                    part = place[i : i + PASSED_ROWS + 1]
                    n = len(part) - 1
                    data = _joined([seen[part[0] : part[-1]]], (part - part[0]) * 2 * kind.itemsize)
                    yield pa.RecordBatch.from_arrays([words.slice(i, n), data, pa.array(np.full(n, block)), pa.array(np.arange(i, i + n, dtype=np.int32))], names=_NEAR)

    return rows.select("block", *_TRAINED, "words").mapInArrow(run, "word binary, seen binary, block bigint, number int")


def rare_classes(rows: DataFrame, items: Items, own: np.ndarray, by_ending: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, n, class, places) of every rare word of the training texts: the best class by the classes of its neighbours, and its numbers in blocks."""
    classes = len(pairs)
    kind = number_type(classes)
    shared = rows.sparkSession.sparkContext.broadcast((by_ending, list(items.endings), pairs.astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_ending, endings, pairs = shared.value
        numbers = pa.array(endings, pa.string())

        def judged(words: pa.Array, seen: pa.Array, block: pa.Array, number: pa.Array, new: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(new)
            each = pc.binary_length(seen).to_numpy() // (2 * kind.itemsize)
            word = np.repeat(np.cumsum(new) - 1, each) * (classes + 1)
            at = np.frombuffer(b"".join(seen.to_pylist()), dtype=kind).reshape(-1, 2)
            left, right = (np.bincount(word + at[:, k], minlength=len(first) * (classes + 1)).reshape(-1, classes + 1).astype(float) for k in (0, 1))
            # words that only texts to be scored have stay with the class of their ending
            known = right.sum(1) > 0
            left, right, words = left[known], right[known], words.take(pa.array(first[known]))
            start = by_ending[ending_numbers(words, numbers)]
            alone = right[:, classes] == 0
            best = start.copy()
            best[alone] = best_classes(pairs, start[alone], right[alone, :classes], left[alone, :classes])
            for k in np.flatnonzero(~alone):
                best[k] = best_class(pairs.copy(), int(start[k]), right[k, :classes], left[k, :classes], right[k, classes])
            n = pa.array(right.sum(1).astype(np.int64))
            rows = np.diff(first, append=len(new))
            places = np.empty(int(rows[known].sum()), dtype=_PLACE)
            here = np.repeat(known, rows)
            places["block"], places["number"] = block.to_numpy()[here], number.to_numpy()[here]
            data = _joined([places.view("u1")], np.concatenate(([0], np.cumsum(rows[known]))) * _PLACE.itemsize)
            return pa.RecordBatch.from_arrays([words, n, pa.array(best.astype(np.int32)), data], names=["word", "n", "class", "places"])

        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(map(len, held)) < JUDGED_ROWS:
                    continue
            if not held:
                continue
            near = [pa.concat_arrays([x.column(k) for x in held]) for k in range(4)]
            words = near[0]
            new = np.concatenate(([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            # the last word may go on in the next batch
            end = len(words) if batch is None else int(np.flatnonzero(new)[-1])
            held = [pa.RecordBatch.from_arrays([x[end:] for x in near], names=_NEAR)] if end < len(words) else []
            if end:
                yield judged(*(x[:end] for x in near), new[:end])

    small_batches(rows.sparkSession)
    near = rare_neighbours(rows, own, by_ending, classes).repartition("word").sortWithinPartitions("word")
    return near.mapInArrow(run, "word binary, n bigint, class int, places binary")


def by_block(words: DataFrame, classes: int) -> DataFrame:
    """(block, met): parts of the numbers, classes and counts of each block's rare words, in planes."""
    kind = number_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def parts() -> pa.RecordBatch:
            at, of, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((at["number"], at["block"]))
            at, of, n = at[order], of[order], n[order]
            first = np.flatnonzero(np.diff(at["block"], prepend=-1))
            met = []
            for i, k in zip(first, [*first[1:], len(at)], strict=True):
                met.append(planes(np.diff(at["number"][i:k], prepend=0).astype("<i4")) + of[i:k].tobytes() + planes(n[i:k]))
            return pa.RecordBatch.from_arrays([pa.array(at["block"][first]), pa.array(met, pa.binary())], names=["block", "met"])

        for batch in batches:
            each = pc.binary_length(batch.column("places")).to_numpy() // _PLACE.itemsize
            of, n = batch.column("class").to_numpy().astype(kind), batch.column("n").to_numpy().astype("<i8")
            held.append((np.frombuffer(b"".join(batch.column("places").to_pylist()), dtype=_PLACE), np.repeat(of, each), np.repeat(n, each)))
            size += len(held[-1][0])
            if size > TASK_NEIGHBOURS:
                yield parts()
                size = 0
        if held:
            yield parts()

    met = words.select("n", "class", "places").mapInArrow(run, "block bigint, met binary")
    return met.groupBy("block").agg(F.collect_list("met").alias("met"))


_PLACED = "doc_id bigint, scored boolean, trained boolean, n_tokens bigint, n_known bigint, logs double, classes binary"


def place(rows: DataFrame, items: Items, of: np.ndarray, by_ending: np.ndarray, words: DataFrame, classes: int) -> DataFrame:
    """Every text's class of each token, `classes` more for rare words; how many are known, and the sum of log10(count + 0.5)."""
    kind = number_type(classes)
    shared = rows.sparkSession.sparkContext.broadcast((of, by_ending, items.own_counts()))
    names = [c.split()[0] for c in _PLACED.split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, by_ending, count = shared.value
        for batch in batches:
            for k, row, rare, number, ends in unpack(batch, every=True):
                at = of[row]
                at[rare] = classes + by_ending[ends]
                logs, known = np.log10(count + 0.5)[row[1:]], (count > 0)[row[1:]].astype(np.int64)
                logs[rare - 1] = known[rare - 1] = 0
                n = batch.column("n")[k].values.to_numpy()
                start = np.cumsum(n) - n
                sums = [pa.array([np.add.reduceat(x, start)]) for x in (known, logs)]
                data = [pa.array([x], pa.binary()) for x in (at[1:].astype(kind).tobytes(), planes(number.astype("<i4")))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in _TEXTS), *sums, *data], names=[*_TEXTS, "n_known", "logs", "classes", "numbers"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                at = np.frombuffer(batch.column("classes")[k].as_py(), dtype=kind).copy()
                number = from_planes(batch.column("numbers")[k].as_py(), "<i4")
                size = int(number.max(initial=-1)) + 1
                met, count = np.full(size, -1), np.zeros(size)
                for part in batch.column("met")[k].as_py() or ():
                    some = len(part) // (4 + kind.itemsize + 8)
                    here = np.cumsum(from_planes(part[: 4 * some], "<i4"))
                    met[here] = np.frombuffer(part, dtype=kind, count=some, offset=4 * some)
                    count[here] = from_planes(part[(4 + kind.itemsize) * some :], "<i8")
                rare, found = np.flatnonzero(at >= classes), met[number]
                at[rare] = np.where(found < 0, at[rare], classes + found)
                more, more_logs = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
                more[rare], more_logs[rare] = found >= 0, np.log10(count + 0.5)[number]
                n = batch.column("n")[k].values.to_numpy().astype(np.int64)
                start = np.cumsum(n) - n
                known = batch.column("n_known")[k].values.to_numpy() + np.add.reduceat(more, start)
                logs = batch.column("logs")[k].values.to_numpy() + np.add.reduceat(more_logs, start)
                data = _joined([at], np.concatenate(([0], np.cumsum(n))) * kind.itemsize)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k].values for c in ("doc_id", "scored", "trained")), pa.array(n), pa.array(known), pa.array(logs), data], names=names)

    small_batches(rows.sparkSession)
    kinds = "block bigint, doc_id array<bigint>, scored array<boolean>, trained array<boolean>, n array<int>, n_known array<bigint>, logs array<double>, classes binary, numbers binary"
    local = rows.select(*_TEXTS, "items", "endings").mapInArrow(first, kinds)
    return local.join(by_block(words, classes), "block", "left").mapInArrow(last, _PLACED)


@dataclass
class Model:
    """Log10 probabilities by item: step[a, b] of moving on from class a to b, emit[i] of item i in its class."""

    items: Items
    of: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit_rows(rows: DataFrame, items: Items, classes: int) -> tuple[Model, DataFrame]:
    """The model of the texts that are trained on, and the classes of all texts' tokens."""
    size = items.base + items.core_endings + 1
    seen = adjacency(rows, items.core, items.of_endings(), size)
    core = exchange(seen, classes)
    by_ending = core[items.of_endings()]
    member = np.eye(classes)[core]
    of, by_ending = assign(rows, items, core[items.core], by_ending, member.T @ seen @ member)
    words = materialise(rare_classes(rows, items, of, by_ending, adjacency(rows, of, by_ending, classes)), "lm-words")
    placed = materialise(place(rows, items, of, by_ending, words, classes), "lm-classes")
    words = words.drop("places")
    shared = rows.sparkSession.sparkContext.broadcast(int(of[0]))
    kind = number_type(classes)

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        at = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind).astype(np.int64) % classes
        if len(at):
            yield np.concatenate(([shared.value], at[:-1])) * classes + at

    pairs = matrix(counted(placed.where("trained").select("classes"), codes), classes)
    rare = np.zeros((classes, 2))
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        rare[r["class"]] = r["n"], r["words"]
    items.classes = classes
    items.item.learn(items, words, by_ending)
    of = np.concatenate((of, np.arange(classes)))
    step = np.log10((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * classes))
    counts = np.concatenate((items.own_counts(), rare[:, 0])) + 0.5
    emit = np.log10(counts / np.bincount(of, weights=counts, minlength=classes)[of])
    emit[len(items.own) :] -= np.log10(rare[:, 0] + 0.5 * (rare[:, 1] + 1))
    return Model(items, of, step, emit), placed


def flagged(docs: DataFrame, *, scored: Column | bool, trained: Column | bool) -> DataFrame:
    flag = lambda c: c if isinstance(c, Column) else F.lit(c)
    return docs.select("doc_id", flag(scored).alias("scored"), flag(trained).alias("trained"), "text")


def fit(docs: DataFrame, items: Items, classes: int = CLASSES) -> Model:
    rows = keep_blocks(item_rows(flagged(docs, scored=False, trained=True), items))
    return fit_rows(rows, items, classes)[0]


def score_rows(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """score of the flagged texts."""
    counts = materialise(word_counts(docs.where("trained")), "lm-counts")
    items = choose_items(counts)
    discard(counts)
    model, placed = fit_rows(keep_blocks(item_rows(docs, items)), items, classes)
    own = len(items.own)
    # what an item's class takes from its own count's log: the same for all words of a class
    whole = model.emit[:own] - np.log10(items.own_counts() + 0.5)
    held = np.zeros(classes)
    held[model.of[:own]] = whole
    shared = docs.sparkSession.sparkContext.broadcast((int(model.of[0]), model.step, np.concatenate((held, model.emit[own:]))))
    kind = number_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step, emit = shared.value
        for batch in batches:
            texts = batch.column("classes").to_pylist()
            at = np.frombuffer(b"".join(texts), dtype=kind).astype(np.int64)
            n = np.array([len(x) // kind.itemsize for x in texts], dtype=np.int64)
            to = at % classes
            one = step[np.concatenate(([end], to))[:-1], to] + emit[at]
            found = np.add.reduceat(one, np.cumsum(n) - n) if len(n) else one
            sums = pa.array(found + batch.column("logs").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")), sums], names=["doc_id", "n_tokens", "n_known", "logs", "score"])

    small_batches(docs.sparkSession)
    found = placed.where("scored").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double")
    base = math.log10(items.total + 0.5 * (items.distinct + 1))
    return found.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(items.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
    )


def score(docs: DataFrame, training: DataFrame, classes: int = CLASSES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    both = flagged(docs, scored=True, trained=False).union(flagged(training, scored=False, trained=True))
    return score_rows(both, classes)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 5) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_rows(flagged(docs, scored=True, trained=~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
