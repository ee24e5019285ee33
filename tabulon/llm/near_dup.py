"""Near-duplicate detection with SuperMinHash.

Each text's set of word shingles gets a SuperMinHash signature: every element visits the slots
in its own permuted order, with rank j plus a fraction as its value in the j-th slot it
visits; a slot keeps the least value. Ranks differ from slot to slot for one element, which
lowers the variance against independent hashes, and once all slots of a text are filled no
later rank can change them, so the visit stops early. Visits run rank by rank over the
elements of many texts at once. Bands of slots give buckets of candidate texts; at a
similarity of 0.8 a pair misses all 42 bands of 6 slots with probability 3e-6.

No bucket is turned into all of its pairs. Texts with equal sets are one class from the
start. In a bucket every class is paired with the bucket's hub, the class with the largest
share of shingles that other candidates have too; after those links are verified on full sets
and grouped by union-find, pairs across groups of a bucket remain. Of these only pairs are
made that can still be linked: the intersection is at most m, the least of s and s', the
shingles each shares with any other candidate, and of (n + n' - d) / 2, where d is the number
of bits in which bitmaps of the two sets differ; 100 m >= 80 (n + n' - m) must hold. Copies too
far from each other fail this inside the join. The bound never drops a link.

Defined results: a null text, or one without a word, has no shingles and is linked with
nothing; rows with a null doc_id are linked with nothing and have a null component; rows with
equal ids are one document to the grouping; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, small_batches, table

WORDS = 5
SIMILARITY = 80
BANDS, ROWS = 42, 6
#: Words of 64 bits, at least, of the bitmap that bounds an intersection; a larger set has four bits a shingle or more.
BITMAP_WORDS = 16
#: Random orders of the slots; an element picks one, and rotates it.
ORDERS = 1024
#: Texts whose signatures are made at once, and elements in them at most, unless one text has more.
TEXTS_AT_ONCE, ELEMENTS_AT_ONCE = 2048, 1_000_000
#: Parts that the rows of one set are dealt to, so that many copies of a text do not meet in one task.
SALTS = 256
#: Word hashes that a worker keeps.
CACHE_WORDS = 500_000

ORACLE_SQL = None

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[bytes, int] = {}
_PERMUTED: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (A-Z lower-cased)."""
    split = text.lower().split() if text else []
    if not split:
        return np.empty(0, dtype=np.uint64)
    known = _HASHES
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(split):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    one = np.fromiter(map(known.__getitem__, split), dtype=np.uint64, count=len(split))
    size = min(words, len(one))
    code = np.full(len(one) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        code = _mix(code * _STEP + one[k : len(one) - size + 1 + k])
    return np.unique(code)


def _orders(slots: int) -> np.ndarray:
    if slots not in _PERMUTED:
        rng = np.random.default_rng(slots)
        _PERMUTED[slots] = np.stack([rng.permutation(slots) for _ in range(ORDERS)]).astype(np.int64)
    return _PERMUTED[slots]


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures; a row of ones for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), slots), _FULL)
    element = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    orders = _orders(slots)
    pick = _mix(element ^ _STEP)
    order, turn = (pick % np.uint64(ORDERS)).astype(np.int64), ((pick >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
    flat = out.ravel()
    for rank in range(slots):
        if not len(element):
            break
        slot = (orders[order, rank] + turn) % slots
        value = np.uint64(rank) << np.uint64(48) | _mix(element + np.uint64((rank + 1) * int(_STEP) % (1 << 64))) >> np.uint64(16)
        np.minimum.at(flat, owner * slots + slot, value)
        open_texts = (out == _FULL).any(axis=1)
        live = open_texts[owner]
        if not live.all():
            element, owner, order, turn = element[live], owner[live], order[live], turn[live]
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        code = _mix(code * _STEP + parts[:, :, k])
    return code.view(np.int64) if code.flags.c_contiguous else np.ascontiguousarray(code).view(np.int64)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, number of shingles, a 128-bit digest of the set, and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        waiting = 0

        def rows() -> pa.RecordBatch:
            found = band_hashes(signatures(sets, BANDS * ROWS))
            filled = [len(s) > 0 for s in sets]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    _lists(found[np.asarray(filled)].ravel(), [BANDS * f for f in filled]),
                ],
                names=["doc_id", "n", "digest", "bands"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text, words))
                waiting += len(sets[-1])
                if len(sets) >= TEXTS_AT_ONCE or waiting >= ELEMENTS_AT_ONCE:
                    yield rows()
                    ids.clear()
                    sets.clear()
                    waiting = 0
        if sets:
            yield rows()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, digest binary, bands array<bigint>")


def bitmap(items: np.ndarray) -> np.ndarray:
    """Words in which every item sets a bit: a power of two of them, by the size of the set."""
    words = max(BITMAP_WORDS, 1 << max(len(items) // 16 - 1, 0).bit_length())
    out = np.zeros(words, dtype=np.uint64)
    bit = items % np.uint64(64 * words)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def differing(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ, the larger folded once to the other's size; null if that is not enough."""
    half = lambda b: F.size(b).cast("int") / 2

    def folded(b: Column) -> Column:
        n = half(b).cast("int")
        return F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, n + 1, n), lambda p, q: p.bitwiseOR(q))

    x, y = F.when(F.size(x) == 2 * F.size(y), folded(x)).otherwise(x), F.when(F.size(y) == 2 * F.size(x), folded(y)).otherwise(y)
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, n: a + n)
    return F.when(F.size(x) == F.size(y), bits)


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The id, the sorted shingle hashes and their bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
            held = [bitmap(s) for s in sets]
            maps = np.concatenate(held).view(np.int64) if sets else np.empty(0, dtype=np.int64)
            columns = [batch.column(0), _lists(values, [len(s) for s in sets]), _lists(maps, [len(m) for m in held])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "items", "bits"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, items array<bigint>, bits array<bigint>")


def verify(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    close = 100 * both >= similarity * (F.size("_x") + F.size("_y") - both)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")


def _forests(links: DataFrame) -> DataFrame:
    """Each partition's links as (node, root), by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], names=["node", "root"])

    return links.select("a", "b").mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the least id of the component.

    Partitions reduce their links to forests; then every node's neighbours are hung under the
    least one, first the larger neighbours, then the smaller, until nothing changes.
    """
    edges = materialise(_forests(links).distinct(), "components")
    while True:
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("low"))
        large = both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.where("node != root").distinct()
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        joined = large.join(least, "node")
        small = joined.where("root != low").select(F.col("root").alias("node"), F.col("low").alias("root")).union(least.select("node", F.col("low").alias("root"))).distinct()
        after = materialise(small, "components")
        # done when no node has two roots and no root is a node
        roots = after.select(F.col("root").alias("node")).distinct()
        twice = after.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
        if after.join(roots, "node", "left_semi").select("node").union(twice).isEmpty():
            return after
        edges = after


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, id) whose key another id has too.

    Least and greatest ids are summed up before the shuffle, and the rows come back by a join, which
    can split a key that many rows have; a window would send all of them to one task.
    """
    ends = rows.groupBy(key).agg(F.min("id").alias("_least"), F.max("id").alias("_most")).where("_least < _most").select(key)
    return rows.join(ends, key, "left_semi")


def _buckets(sketches: DataFrame) -> DataFrame:
    """(band, id) of the classes that share a band with another class."""
    return _shared(sketches.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id")), "band")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sketches = materialise(sketch(docs, words), "near-sketches").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("short"))
    # equal sets are one class: its least id and its bands come from sums over salted parts
    part = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "salt").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    parts = materialise(part, "near-classes")
    classes = parts.groupBy("digest").agg(F.min("rep").alias("rep"), F.collect_list("salt").alias("salts"))
    heads = parts.select("digest", "rep", "bands").groupBy("digest").agg(F.min("rep").alias("doc_id"), F.first("bands").alias("bands")).select("doc_id", "bands").distinct()
    buckets = materialise(_buckets(heads), "near-buckets")
    members = buckets.select("id").distinct()
    texts = docs.join(members, docs["doc_id"] == members["id"], "left_semi").select("doc_id", "text")
    sets = materialise(full_sets(texts, words).where(F.size("items") > 0).distinct(), "near-sets")

    # s: a class's shingles that another candidate has; 32 bits of a hash can only raise it
    items = sets.select("id", F.explode("items").alias("item")).select("id", F.shiftright("item", 32).cast("int").alias("item"))
    met = _shared(items, "item")
    shared = met.groupBy("id").agg(F.count("*").alias("s"))
    facts = sets.groupBy("id").agg(F.max(F.size("items")).alias("n"), F.min(F.size("items")).alias("least")).join(shared, "id", "left")
    # the bitmap of an id with several texts is unknown, and bounds nothing
    single = sets.groupBy("id").agg(F.count("*").alias("_c"), F.first("bits").alias("bits")).select("id", F.when(F.col("_c") == 1, F.col("bits")).alias("bits"))
    sized = materialise(buckets.join(facts.select("id", "n", "least", F.coalesce("s", F.lit(0)).alias("s")), "id"), "near-sized")

    hubs = sized.groupBy("band").agg(F.max(F.struct(F.col("s") / F.col("n"), -F.col("id"), F.col("id").alias("id")))["id"].alias("b"))
    stars = sized.join(hubs, "band").select(F.col("id").alias("a"), "b").where("a != b").distinct()
    links = materialise(verify(stars, sets, similarity), "near-links")
    found = components(links)

    grouped = sized.join(found, F.col("id") == F.col("node"), "left").select("band", "id", "n", "least", "s", F.coalesce("root", "id").alias("root"))
    ends = grouped.groupBy("band").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), F.min("least").alias("_small")).where("_least < _most")
    reach = lambda small, s, n: (100 + similarity) * s >= similarity * (n + small)
    still = materialise(grouped.join(ends.select("band", "_small"), "band").where(reach(F.col("_small"), F.col("s"), F.col("least"))).join(single, "id").select("band", "id", "least", "s", "root", "bits"), "near-open")
    x, y = still.alias("x"), still.alias("y")
    differ = differing(F.col("x.bits"), F.col("y.bits"))
    most = F.least("x.s", "y.s", F.coalesce(F.floor((F.col("x.least") + F.col("y.least") - differ) / 2), F.lit(1 << 40)))
    could = reach(F.col("y.least"), most, F.col("x.least"))
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & could)
    rest = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = materialise(verify(rest, sets, similarity), "near-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.explode("salts").alias("salt"), F.coalesce("root", "rep").alias("_component"))
    whole = sketches.select("doc_id", "n", "digest", "salt").join(named, ["digest", "salt"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id"))
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
