"""Exact top-k search for binary codes by incremental multi-index hashing.

A code is cut into m segments, each indexed by its value. If a code is within distance d of a
query, one of its segments is within d // m of the query's. Looking up, radius after radius,
all segment values within r of the query's therefore finds every code within m (r + 1) - 1;
a query is done when it has k rows within that bound, which proves its kth distance, and only
queries that are not done go on to the next radius.

Rows with equal codes are one class with a count and its k least ids, for queries and rows
alike. Segment length follows the number of distinct codes, so that a bucket holds about
BUCKET codes; a bucket that holds many more, as similar codes can make it, is split into
parts by a hash of the code. A look-up returns only its k best of a bucket part.

A code is an array of 64-bit words, as many as the longest vector fills; every vector of a search
has as many. Segments do not cross words.

Defined results: rows with a null vector or id take no part; every vector element that is
greater than 0 sets its bit (null and missing elements leave 0); equal distances go by id; a
query finds itself too; repeated rows count as rows; fewer than k rows are all returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import let, materialise, table

#: Bits of a word of a code.
WORD = 64
K = 10
#: Codes that a bucket is meant to hold, and those in one part of it.
BUCKET = 256
PART = 2048

ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: ((q.e[i] > 0) <> (v.e[i] > 0))::INTEGER))::INTEGER AS distance
      FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def words_of(rows: DataFrame, vector: str) -> int:
    """Words that the longest vector fills, one at least."""
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 1
    return max(1, -(-longest // WORD))


def sign_code(vector: Column, words: int = 1) -> Column:
    """Bit i of the words is set where element i is greater than 0."""

    def word(k: int) -> Column:
        part = F.slice(vector, k * WORD + 1, WORD)
        bits = F.transform(part, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.array(*[word(k) for k in range(words)])


def segments(n_codes: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each segment for so many codes."""
    bits = min(20, max(4, round(math.log2(max(n_codes, 1) / BUCKET)) if n_codes > BUCKET else 4))
    m = -(-WORD // bits)
    cuts = [WORD * k // m for k in range(m + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def _values(code: str, parts: list[tuple[int, int, int]]) -> Column:
    """Segment number and value of each segment."""
    value = lambda word, shift, bits: F.shiftrightunsigned(F.col(code)[word], shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("segment"), F.lit(bits).alias("bits"), value(word, shift, bits).alias("value")) for k, (word, shift, bits) in enumerate(parts)])


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), radius)]


def _least(found: Column, k: int) -> Column:
    """The k least entries."""
    return F.slice(F.sort_array(found), 1, k)


def _best(found: Column, k: int) -> Column:
    """The k least entries, each once: sorted, equal ones lie side by side."""
    once = lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))
    return let(F.sort_array(found), lambda s: F.slice(once(s), 1, k))


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest rows of each query.

    rows: (vec_id, code); queries: (query_id, code); codes of equal numbers of words.
    """
    spark = rows.sparkSession
    least = F.row_number().over(Window.partitionBy("code", "_salt").orderBy("vec_id"))
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_r", least)
    # counts and least ids first within salted parts of a class, then over its parts
    parts_of = some.groupBy("code", "_salt").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.col("vec_id")))).alias("ids"))
    classes = materialise(
        parts_of.groupBy("code").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids")), "codes"
    )
    total, words = classes.agg(F.count("*"), F.coalesce(F.max(F.size("code")), F.lit(1))).first()
    parts = segments(total, words)
    m, widest = len(parts), max(b for _, _, b in parts)
    index = classes.select("code", "n", F.col("ids")[0].alias("first"), F.explode(_values("code", parts)).alias("s")).select("code", "n", "first", "s.segment", "s.value")
    fullest = index.groupBy("segment", "value").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    split = max(1, -(-fullest // PART))
    entry = F.struct("first", "code", "n")
    dealt = index.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(split)))
    buckets = materialise(dealt.groupBy("segment", "value", "part").agg(F.collect_list(entry).alias("held")), "code-buckets")

    wanted = materialise(queries.select(F.col("code").alias("query")).distinct(), "code-queries")
    kinds = "array<struct<distance: int, first: bigint, code: array<bigint>, n: bigint>>"
    open_ = wanted.select("query", F.array().cast(kinds).alias("best"))
    done: DataFrame | None = None
    for radius in range(widest + 1):
        flips = None
        for bits in sorted({b for _, _, b in parts}):
            masks = F.lit(_flips(bits, radius)).cast("array<int>") if radius <= bits else F.array().cast("array<int>")
            flips = F.when(F.col("s.bits") == bits, masks) if flips is None else flips.when(F.col("s.bits") == bits, masks)
        probes = open_.select("query", F.explode(_values("query", parts)).alias("s")).select("query", "s.segment", F.explode(F.transform(flips, lambda f: F.col("s.value").bitwiseXOR(f))).alias("value"))
        met = probes.join(buckets, ["segment", "value"])
        distance = lambda x: sum((F.bit_count(F.col("query")[w].bitwiseXOR(x["code"][w])) for w in range(words)), F.lit(0)).cast("int")
        near = F.transform("held", lambda x: F.struct(distance(x).alias("distance"), x["first"].alias("first"), x["code"].alias("code"), x["n"].alias("n")))
        # a code is in a bucket once, so only buckets' results can repeat it
        found = met.select("query", _least(near, k).alias("best")).union(open_.select("query", "best"))
        best = found.groupBy("query").agg(_best(F.flatten(F.collect_list("best")), k).alias("best"))
        bound = m * (radius + 1) - 1
        rows_within = F.aggregate(F.filter("best", lambda x: x["distance"] <= bound), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        after = materialise(best.withColumn("covered", (rows_within >= k) | F.lit(bound >= WORD * words)), "code-search")
        finished = after.where("covered").select("query", "best")
        done = finished if done is None else done.union(finished)
        open_ = after.where("NOT covered").select("query", "best")
        if open_.isEmpty():
            break

    hits = done.select("query", F.explode("best").alias("b")).select("query", "b.distance", F.col("b.code").alias("code"))
    ids = hits.join(classes.select("code", "ids"), "code").select("query", F.explode("ids").alias("vec_id"), "distance")
    order = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    ranked = ids.withColumn("rank", order).where(F.col("rank") <= k)
    return queries.join(ranked, F.col("code") == F.col("query")).select("query_id", "rank", "vec_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    rows = materialise(known.select("vec_id", sign_code(F.col("embedding"), words_of(known, "embedding")).alias("code")), "sign-codes")
    return search(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "code"))
