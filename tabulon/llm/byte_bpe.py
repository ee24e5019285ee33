"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Documents are cut into blocks. A block explodes its texts into pre-tokens with positions and
keeps each distinct word once: the block's texts become index sequences into its word list.
The word lists are dealt by a hash of the word, so that all blocks' rows of one word meet in
one place, where each distinct word is encoded once. The ids go back to the blocks, where
they are put together by position. A frequent word costs one row a block, not one an
occurrence. Rows travel in packs, one for each block and bucket, compressed.

Decoding joins ids with the token-byte table (one row for each rank of the file: a fixed,
small table). Where ids are put together the join is made on the spot, in the block's worker,
which holds the table; ``decode`` does it for any table of ids, as a broadcast join.

Buckets grow in number with the text, so that the distinct words of one stay of a size; a worker
forgets words, oldest first, beyond a bound, which costs encoding them again and nothing else.

Defined results: a null or empty text has no ids and decodes to no bytes; rows with equal ids
stay rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, small_batches, table
from tabulon.llm.pieces import cut

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text in a block at most, unless one text alone is longer.
BLOCK_CHARS = 32_000_000
#: Texts that are compressed together.
TEXTS_TOGETHER = 64
#: Characters of text for each bucket of distinct words, and buckets at most (a block's list is cut into so many).
BUCKET_CHARS, MAX_BUCKETS = 128_000_000, 4096
#: Encoded words in each of the two halves that a worker keeps.
SEEN_WORDS = 500_000
#: Piece splits that a worker keeps while it makes a block.
SPLIT_CACHE = 200_000

ORACLE_SQL = None

_SPLIT = regex.compile(public_tokenizers.PATTERN)
_ENCODERS: dict[str, object] = {}
_TOKENS: dict[str, list[bytes]] = {}

_BLOCKS = "block string, bucket int, doc_ids array<bigint>, sizes array<int>, payload binary"
#: What a row of a block holds, if not a bucket's word list (its number, from 0).
_TEXTS, _PLACES = -1, -2
_IDS = "block string, bucket int, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as rows:
        return {base64.b64decode(token): int(rank) for token, rank in (row.split() for row in rows if row.strip())}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


def _token_bytes(path: str) -> list[bytes]:
    """The token-byte table by id."""
    if path not in _TOKENS:
        ranks = read_ranks(path)
        out = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        _TOKENS[path] = out
    return _TOKENS[path]


def _pack(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), dtype="<u4", count=len(parts)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(parts).to_bytes(4, "little") + lengths + b"".join(parts))


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64) + 4 + 4 * n
    out, start = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[start:end])
        start = end
    return out


class _Block:
    """Texts as index sequences into the list of their distinct words."""

    def __init__(self, name: str) -> None:
        self.name, self.index, self.splits = name, {}, {}
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.chars = 0

    def _indices(self, piece: str) -> tuple[int, ...]:
        got = self.splits.get(piece)
        if got is None:
            index = self.index
            got = tuple(index.setdefault(m[0], len(index)) for m in _SPLIT.finditer(piece))
            if len(self.splits) < SPLIT_CACHE and len(piece) <= 64:
                self.splits[piece] = got
        return got

    def add(self, doc_id: int | None, text: str) -> None:
        flat = [i for piece in cut(text) for i in self._indices(piece)]
        self.docs.append((doc_id, np.asarray(flat, dtype="<u4")))
        self.chars += len(text)

    def batches(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The texts, the bucket of every word, and the word lists by bucket.

        Words are numbered by falling frequency, so that the sequences compress; a bucket's
        list has its words in that order.
        """
        words = list(self.index)
        if self.docs:
            flat = np.concatenate([d for _, d in self.docs])
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number = np.empty(len(words), dtype="<u4")
            number[order] = np.arange(len(words), dtype="<u4")
            for k in range(0, len(self.docs), TEXTS_TOGETHER):
                some = self.docs[k : k + TEXTS_TOGETHER]
                data = number[np.concatenate([d for _, d in some])]
                # a null id is a 0 with its size turned to ~size: a list with nulls would lose digits on the way to pandas
                yield _batch(self.name, _TEXTS, [i or 0 for i, _ in some], [~len(d) if i is None else len(d) for i, d in some], _squeeze(data))
            words = [words[i].encode() for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype="<u4", count=len(words))
        yield _batch(self.name, _PLACES, [], [], _squeeze(bucket))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if words else []:
            yield _batch(self.name, int(bucket[part[0]]), [], [], _pack([words[i] for i in part.tolist()]))


#: Numbers whose bits are packed at once, which bounds the memory that it takes.
BITS_TOGETHER = 65_536
_WIDTH = np.arange(32, dtype=np.uint32)


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as their bit lengths, compressed, and their lower bits, packed.

    Words numbered by falling frequency are about evenly spread between powers of two, so
    this comes close to the entropy of the sequence.
    """
    n = numbers.astype(np.uint32) + np.uint32(1)
    length = np.frexp(n.astype(np.float64))[1].astype(np.uint8)  # n has so many bits, the first always set
    head = zstandard.ZstdCompressor(level=3).compress(length.tobytes())
    parts = [len(head).to_bytes(4, "little"), head]
    for k in range(0, len(n), BITS_TOGETHER):
        some, size = n[k : k + BITS_TOGETHER, None], length[k : k + BITS_TOGETHER, None]
        at = _WIDTH[None, : int(size.max()) - 1]
        parts.append(np.packbits((some >> at & np.uint32(1)).astype(bool)[at < size - 1]).tobytes())
    return b"".join(parts)


def _numbers(data: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(data[:4], "little")
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:end]), dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(length), dtype=np.uint32)
    for k in range(0, len(length), BITS_TOGETHER):
        size = length[k : k + BITS_TOGETHER, None]
        at = _WIDTH[None, : int(size.max()) - 1]
        held, count = np.zeros((len(size), at.shape[1]), dtype=np.uint32), int((size - 1).sum())
        held[at < size - 1] = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=end, count=-(-count // 8)), count=count)
        end += -(-count // 8)
        out[k : k + BITS_TOGETHER] = (held << at).sum(axis=1, dtype=np.uint32) | np.uint32(1) << (size[:, 0] - 1).astype(np.uint32)
    return out - np.uint32(1)


def _batch(block: str, bucket: int, doc_ids: list, sizes: list[int], payload: bytes) -> pa.RecordBatch:
    arrays = [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([payload])]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "bucket", "doc_ids", "sizes", "payload"])


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents as sequences of word numbers, and the lists of distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        block = _Block(f"{part}-0")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block.chars and block.chars + len(text or "") > BLOCK_CHARS:
                    yield from block.batches(buckets)
                    made += 1
                    block = _Block(f"{part}-{made}")
                block.add(doc_id, text or "")
        yield from block.batches(buckets)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _BLOCKS)


def encode_words(lists: DataFrame, ranks: str, buckets: int) -> DataFrame:
    """Every distinct word encoded once, where all blocks' lists of its bucket meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _encoder(ranks)._encode_single_piece
        seen: dict[bytes, bytes] = {}
        old: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            out = []
            for at, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != bucket:  # another bucket has other words
                    bucket, seen, old = at, {}, {}
                words = _unpack(payload)
                for word in words:
                    if word not in seen:
                        ids = old.get(word)
                        seen[word] = np.asarray(piece(word), dtype="<u4").tobytes() if ids is None else ids
                out.append(_pack([seen[w] for w in words]))
                if len(seen) > SEEN_WORDS:
                    seen, old = {}, seen
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return lists.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _IDS)


def bucket_count(docs: DataFrame) -> int:
    """Buckets for so much text: one for each BUCKET_CHARS, and as many as there are shuffle partitions."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MAX_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS)))


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """The token-byte table: (id, bytes), a row for each rank of the file."""
    return spark.createDataFrame([(rank, token) for token, rank in read_ranks(ranks).items()], "id int, bytes binary")


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the bytes that each row's ids stand for, by a join with the token-byte table.

    Rows are told apart by a number of their own, so equal and null keys are no matter; a row
    without ids has no bytes.
    """
    rows = materialise(encoded.select(F.col(key), F.col(ids).alias("_ids")).withColumn("_row", F.monotonically_increasing_id()), "bpe-ids")
    each = rows.select("_row", F.posexplode("_ids").alias("_at", "id"))
    met = each.join(F.broadcast(token_table(encoded.sparkSession, ranks)), "id")
    placed = F.transform(F.sort_array(F.collect_list(F.struct("_at", "bytes"))), lambda x: x["bytes"])
    joined = met.groupBy("_row").agg(F.aggregate(placed, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("decoded"))
    return rows.drop("_ids").join(joined, "_row", "left").select(key, F.coalesce("decoded", F.lit(b"").cast("binary")).alias("decoded"))


def encode(docs: DataFrame, *, ranks: str, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to.

    Columns: doc_id, n_tokens, then ids and decoded, or with ``digests`` their SHA-256 in hex
    (of the decimal ids joined by a space, and of the bytes).
    """
    buckets = buckets or bucket_count(docs)
    made = materialise(blocks(docs, buckets), "bpe-blocks")
    texts = made.where("bucket < 0").select("block", "bucket", "doc_ids", "sizes", "payload")
    words = encode_words(made.where("bucket >= 0").select("block", "bucket", "payload"), ranks, buckets)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = ("bigint", "bigint", "string", "string") if digests else ("bigint", "bigint", "array<int>", "binary")

    def put_together(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        table = _token_bytes(ranks)
        decimal = list(map(str, range(len(table))))
        lists = {int(b): iter(_unpack(packed)) for b, packed in zip(words["bucket"], words["ids"], strict=True)}
        places = _numbers(texts.loc[texts["bucket"] == _PLACES, "payload"].iloc[0])
        ids_of = [next(lists[b]) for b in places.tolist()]
        texts = texts[texts["bucket"] == _TEXTS]
        out = []
        for doc_ids, sizes, payload in zip(texts["doc_ids"], texts["sizes"], texts["payload"], strict=True):
            numbers, start = _numbers(payload).tolist(), 0
            for doc_id, size in zip(doc_ids.tolist(), sizes.tolist(), strict=True):
                if size < 0:
                    doc_id, size = None, ~size
                ids = np.frombuffer(b"".join([ids_of[i] for i in numbers[start : start + size]]), dtype="<u4").tolist()
                start += size
                decoded = b"".join([table[i] for i in ids])
                if digests:
                    shown = " ".join([decimal[i] for i in ids])
                    out.append((doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    out.append((doc_id, len(ids), ids, decoded))
        frame = pd.DataFrame(out, columns=columns)
        return frame.assign(doc_id=pd.array([r[0] for r in out], dtype="Int64"))

    schema = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True))
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(put_together, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ranks=public_tokenizers.path(RANKS), digests=True)
