"""Token counts: a two-tier look-up on the map side, without any shuffle of pre-tokens.

The tokenizer drops white space and no pre-token crosses it, so the tokens of a text are the
sum over its blank-separated words. Tier one is a broadcast table of the token lengths of
frequent words; tier two is each worker's own cache, filled by encoding the words that miss.

Frequent words are found over the whole corpus: every task reports the words that make up at
least 1/``frequent`` of its own words, so a word with that share of the corpus is reported by
some task; sums of the reports pick at most ``frequent`` words. The table only saves work;
counts do not depend on it.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted row
by row; an empty table gives an empty result; extra columns are ignored. Special strings
inside texts count as the library counts them by default.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import small_batches, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words in the broadcast table at most, and the longest word in it, in bytes: 2 MB at most.
FREQUENT = 16_384
FREQUENT_BYTES = 64
#: Words in each of the two halves of a worker's cache, and in a task's count before rare ones go.
CACHE_WORDS = 250_000
COUNTED_WORDS = 1_000_000

ORACLE_SQL = None



class _Lengths(dict):
    """Tier two: token lengths by word, kept from task to task; a word that misses is encoded.

    Lookups of known words stay inside the dict type. Words live in two halves: a full new half
    becomes the old one, whose words are moved on when they are met again and go when the next
    half is full. So memory is bounded, and words in use are not encoded anew.
    """

    def __init__(self, tokenizer: str, half: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.encode, self.half = Tokenizer.from_file(tokenizer).encode, half
        self.common: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        n = self.common.get(word)
        if n is None:
            n = self.old.get(word)
        if n is None:
            n = len(self.encode(word.decode(), add_special_tokens=False))
        if len(word) <= FREQUENT_BYTES:
            self[word] = n
        return n

    def turn(self) -> None:
        """Start a new half where this one is full."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


_CACHES: dict[str, _Lengths] = {}


def frequent_words(docs: DataFrame, frequent: int = FREQUENT) -> list[str]:
    """At most ``frequent`` words, among them every word with 1/frequent of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    words = text.split()
                    count.update(words)
                    total += len(words)
            if len(count) > COUNTED_WORDS:
                count = Counter({w: n for w, n in count.items() if n * frequent >= total})
        rows = [(w, n) for w, n in count.items() if n * frequent >= total and n > 1 and len(w) <= FREQUENT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word binary, n bigint")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    return [bytes(r["word"]).decode() for r in top.collect()]


def _token_lengths(tokenizer, words: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def broadcast_lengths(docs: DataFrame, tokenizer: str, frequent: int = FREQUENT) -> Broadcast:
    """Tier one: the frequent words' token lengths."""
    from tokenizers import Tokenizer

    words = frequent_words(docs, frequent)
    lengths = _token_lengths(Tokenizer.from_file(tokenizer), words)
    return docs.sparkSession.sparkContext.broadcast({w.encode(): n for w, n in zip(words, lengths, strict=True)})


def count_tokens(docs: DataFrame, *, tokenizer: str, frequent: Broadcast, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _CACHES:
            _CACHES[tokenizer] = _Lengths(tokenizer)
        lengths = _CACHES[tokenizer]
        lengths.common, of = frequent.value, lengths.__getitem__
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = []
            for t in texts:
                tokens.append(sum(map(of, t.split())))
                lengths.turn()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(TOKENIZER)
    small_batches(spark)
    return count_tokens(docs, tokenizer=path, frequent=broadcast_lengths(docs, path))
