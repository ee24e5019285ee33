"""Language identification by rank-order n-gram profiles.

A profile lists the ``PROFILE`` most frequent 1- to 3-grams of a language's texts by rank. A
document's own most frequent n-grams are ranked the same way and compared with each profile
by the out-of-place distance: the sum of rank differences, PROFILE for an n-gram that the
profile lacks. The nearest profile names the language; ties go to the first in text order.

Texts are lower-cased, letters (Unicode) kept, everything else is a word boundary, and the
n-grams are those of the words padded by one boundary on each side. An n-gram is held as a
64-bit number of its code points, so counting is sorting of integers, in whole batches.

Profiles count every n-gram of every training text; only partial sums of distinct n-grams
meet in a shuffle, and the profiles (languages times PROFILE rows) are all that the driver
gets. The model learns at most ``languages`` labels, those with the most n-grams, so that the
table of profiles that is broadcast is bounded whatever the label column holds.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when nothing could be learned; rows are judged one by one whatever their ids; training
rows with a null text or lang are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import crc_bucket, small_batches, table

PROFILE = 400
#: Labels that are learned at most.
MAX_LANGUAGES = 1000
#: How far from all profiles a text may be where no distances were measured.
FARTHEST = 0.98
UNDETERMINED = "und"

ORACLE_SQL = None

_BITS = 21
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray:
    """Every 1- to 3-gram of the padded words, as numbers; 0 stands for a boundary."""
    if not text:
        return np.empty(0, dtype=np.int64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    raw = np.where(_letters()[raw], raw, 0)
    keep = raw != 0
    keep[1:] |= raw[:-1] != 0  # one boundary of each run
    code = np.concatenate(([0], raw[keep], [0]))
    if len(code) > 1 and code[-2] == 0:
        code = code[:-1]
    one = code[code != 0]
    pair = (code[:-1] << _BITS | code[1:])[(code[:-1] != 0) | (code[1:] != 0)]
    middle = code[1:-1] != 0
    three = ((code[:-2] << _BITS | code[1:-1]) << _BITS | code[2:])[middle]
    # Sizes stay apart: x is 0,0,x; xy is 1,x,y; xyz is x,y,z, where y is a letter. No letter is
    # code point 1, and x,y,z is never 0,0,z.
    return np.concatenate((one, pair | np.int64(1) << 2 * _BITS, three))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams by falling count, equal counts by number."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:size]


def learn(docs: DataFrame, *, lang: str = "lang", size: int = PROFILE, languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Profiles of the languages that the column names, from every given text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(name: str) -> None:
            values, counts = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            if name in sums:
                both = np.concatenate((sums[name][0], values))
                values, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate((sums[name][1], counts))).astype(np.int64)
            sums[name] = (values, counts)

        waiting = 0
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = ngrams(text)
                held.setdefault(name, []).append(got)
                waiting += len(got)
            if waiting > 4_000_000:
                for name in list(held):
                    fold(name)
                waiting = 0
        for name in list(held):
            fold(name)
        for name, (values, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])

    small_batches(docs.sparkSession)
    given = docs.where(F.col("text").isNotNull() & F.col(lang).isNotNull()).select("text", F.col(lang).alias("lang"))
    counts = given.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang")
    placed = counts.withColumn("place", F.row_number().over(of_lang.orderBy(F.desc("n"), "gram"))).withColumn("total", F.sum("n").over(of_lang))
    rows = placed.where(F.col("place") <= size).orderBy(F.desc("total"), "lang", "place").limit(languages * size).collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.asarray(out[name], dtype=np.int64) for name in sorted(list(out)[:languages])}


class Profiles:
    """Distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.empty(0, dtype=np.int64)
        self.place = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.place[k, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1: the lead over the runner-up) and mean distance (0 to 1)."""
        own = ranked(ngrams(text or ""), self.size)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0, 1.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        place = self.place[:, at]
        distance = np.where(place < 0, self.size, np.abs(place - np.arange(len(own)))).sum(axis=1) / (self.size * len(own))
        order = np.argsort(distance, kind="stable")
        best = float(distance[order[0]])
        second = float(distance[order[1]]) if len(order) > 1 else 1.0
        return self.names[order[0]], (second - best) / second if second else 0.0, best


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns (by name), lang_pred, score and distance of every document."""
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))
    given = docs.select(F.col("text").alias("_text"), *keep)
    schema = given.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("distance", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value.judge
        for batch in batches:
            found = [judge(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], "lang_pred", "score", "distance"])

    small_batches(docs.sparkSession)
    return given.mapInArrow(run, schema)


def reach(found: DataFrame, *, lang: str = "lang") -> float:
    """How far from its profile a text of a learned language may be, from measured distances.

    Of each language's texts that are named as labelled, the spread from the median to the 99th
    percentile is added once more to that percentile, and 0.05 to the largest of these sums.
    """
    own = found.where(F.col(lang) == F.col("lang_pred")).groupBy("lang_pred").agg(F.percentile_approx("distance", [0.5, 0.99], 10_000).alias("p"))
    far = own.agg(F.max(2 * F.col("p")[1] - F.col("p")[0])).first()[0]
    return FARTHEST if far is None else min(FARTHEST, far + 0.05)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 3) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), profiles, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
