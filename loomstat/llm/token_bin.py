"""Token ids as bit-packed blocks.

File format: a Parquet table (so any store that Spark writes will do) whose
rows are blocks in ascending order of (shard, block): shard int, block long,
first long (ids before it in its shard), doc_ids array<bigint>, ends array<int> (each document's end, in ids, inside
the block), bits int, n_ids int, payload binary. The payload holds n_ids ids
of `bits` bits each, lowest bit first, without gaps: id k starts at bit
k * bits, so one id or one document is read without the others, and a whole
block unpacks in a few NumPy operations. A document is never cut; blocks end
after about `block_ids` ids.

Documents are in ascending doc_id order, nulls first, equal ids by text: the
text is range-partitioned once, and each range is encoded and packed where it
lies. Null text counts as empty. Each document ends with `end_id`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch_path

BLOCKS = "shard int, block long, first long, doc_ids array<bigint>, ends array<int>, bits int, n_ids int, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi (not included) of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", hi - lo, lo * bits // 8).astype(np.uint32)
    a, b = lo * bits, hi * bits
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
    return (raw.reshape(hi - lo, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: Latin letters, to U+024F, and punctuation after them; an apostrophe may belong to what follows.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?)\]}\"]{0,4})")

#: The byte-level alphabet: visible bytes stand for themselves, the others for the characters from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


class _Known:
    """Ids of chunks by the hash of their bytes, in sorted arrays: about 30 bytes a chunk."""

    def __init__(self):
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Sorted new keys."""
        at = self.used
        while len(self.flat) < at + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(ids)] = ids
        self.used = at + len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.size = np.insert(self.size, place, sizes)
        self.start = np.insert(self.start, place, at + np.cumsum(sizes) - sizes)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each span, one after the other."""
    upto = np.concatenate(([0], np.cumsum(size)))
    return flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]


class ChunkEncoder:
    """Encodes texts by their distinct white-space chunks, which pass the tokenizer together, once a slice.

    Right for tokenizers that normalise and split within white space and drop it, and ignore the case of ASCII chunks:
    `word_bpe_49k.json` does (NFC, lower case, no token spans white space). Chunks with other characters are passed as they are, since
    composing comes before lower case. Texts that hold `<|` keep their case, for special tokens.

    Chunks of a slice are told apart by 64-bit hashes of their bytes, computed for all of them at once; a chunk longer than
    `LONGEST` bytes takes no part in that and is encoded where it stands. The ids of `capacity` chunks and of those before
    them are remembered; what is asked for again stays.
    """

    LONGEST = 256

    def __init__(self, path: str, capacity: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer, self.capacity = Tokenizer.from_file(path), capacity
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.young, self.old = _Known(), _Known()
        self.tails: dict[str, list[int]] = {}  # a fixed number: of up to four of nine characters

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids).

        Chunks are normalised together; one that is then Latin letters with or without punctuation after them is split in two without
        the general pattern, and its letters go to the model itself.
        """
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        ids: list[list[int] | None] = [None] * len(chunks)
        plain = self.tokenizer.normalizer.normalize_str(" ".join(chunks)).split(" ")
        if len(plain) == len(chunks):
            model, tails = self.tokenizer.model.tokenize, self.tails
            for k, m in enumerate(map(_PLAIN.fullmatch, plain)):
                if m:
                    word, tail = m.groups()
                    if tail and tail not in tails:
                        tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                    ids[k] = [t.id for t in model(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]
                    if tail:
                        ids[k] += tails[tail]
        rest = [k for k, x in enumerate(ids) if x is None]
        if rest:
            e = self.tokenizer.encode([chunks[k] for k in rest], is_pretokenized=True, add_special_tokens=False)
            for k in rest:
                ids[k] = []
            for k, i in zip(e.word_ids, e.ids, strict=True):
                ids[rest[k]].append(i)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))

    def _resolve(self, keys: np.ndarray, chunk) -> tuple[np.ndarray, np.ndarray]:
        """(size, start in self.young.flat) of the ids of sorted distinct keys; chunk(k) is the text of the k-th."""
        if len(self.young.keys) + len(keys) > self.capacity:
            self.young, self.old = _Known(), self.young
        new = np.flatnonzero(~K.find_sorted(self.young.keys, keys)[1])
        at, again = K.find_sorted(self.old.keys, keys[new])
        if again.any():
            sizes = self.old.size[at[again]]
            self.young.add(keys[new[again]], sizes, _gather(self.old.flat, self.old.start[at[again]], sizes))
        new = new[~again]
        if len(new):
            self.young.add(keys[new], *self._tokens([chunk(k) for k in new.tolist()]))
        at = K.find_sorted(self.young.keys, keys)[0]
        return self.young.size[at], self.young.start[at]

    def encode_bytes(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; each text's end) of UTF-8 bytes and offsets from 0."""
        n = len(offs) - 1
        start, end = K.word_bounds(data, offs)
        text_of = np.searchsorted(offs, start, "right") - 1
        first_of = np.searchsorted(start, offs)  # each text's first chunk
        low = K._LOWER[data]
        size = end - start
        if len(start):
            keep = np.logical_or.reduceat(data >= 128, start) if (data >= 128).any() else np.zeros(len(start), bool)
            # reduceat runs on to the next chunk's start over white space, which is ASCII
            marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
            if len(marks):
                special = np.zeros(n, bool)
                special[np.searchsorted(offs, marks, "right") - 1] = True
                keep |= special[text_of]
            if keep.any():
                at = np.repeat(start[keep] - np.concatenate(([0], np.cumsum(size[keep])[:-1])), size[keep]) + np.arange(size[keep].sum())
                low[at] = data[at]
        hashes = K.span_hashes(low, start, end)
        short = size <= self.LONGEST
        found, first, where = np.unique(hashes[short], return_index=True, return_inverse=True)
        spans, raw = np.flatnonzero(short)[first], low.tobytes()
        lo, hi = start[spans].tolist(), end[spans].tolist()
        sizes, starts = self._resolve(found, lambda k: raw[lo[k] : hi[k]].decode())
        chunk_size, chunk_start = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        chunk_size[short], chunk_start[short] = sizes[where], starts[where]
        source = self.young.flat[: self.young.used]
        if not short.all():
            sizes, more = self._tokens([raw[start[k] : end[k]].decode() for k in np.flatnonzero(~short)])
            chunk_size[~short], chunk_start[~short] = sizes, len(source) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            source = np.concatenate([source, more])
        upto = np.concatenate(([0], np.cumsum(chunk_size)))
        ends = upto[first_of[1:]] + np.arange(1, n + 1)
        out = np.empty(int(upto[-1]) + n, np.uint32)
        hole = np.ones(len(out), bool)
        hole[ends - 1] = False
        out[ends - 1] = end_id
        out[hole] = _gather(source, chunk_start, chunk_size)
        return out, ends

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*K.string_buffers(pa.array(texts, pa.large_string())), end_id)


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str, text_col: str = "text", end_id: int = 1, block_ids: int = 1 << 16, per_shard: int = 8192) -> None:
    """Encode docs and write the block table to path."""
    n = docs.count()
    shards = max(1, min(-(-n // per_shard), 1 << 16))

    @K.frugal
    def run(batches):
        enc, shard, block, first = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        for b in batches:
            names = b.column(0)
            for i, j, data, offs in K.slices(b.column(1), 3 * block_ids):
                ids, ends = enc.encode_bytes(data, offs, end_id)
                yield pa.RecordBatch.from_pydict(
                    {"shard": [shard], "block": [block], "first": [first], "doc_ids": [names.slice(i, j - i).to_pylist()], "ends": [ends.tolist()], "bits": [bits], "n_ids": [len(ids)], "payload": [pack(ids, bits)]},
                    schema=pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("bits", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary())]),
                )
                block, first = block + 1, first + len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows.mapInArrow(run, BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the number of ids before each."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    sums = sums.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row a shard, 65,536 at most
    return blocks.join(F.broadcast(sums), F.col("shard") == F.col("__shard")).withColumn("start", F.col("__base") + F.col("first")).drop("__shard", "__base")


def map_documents(spark: SparkSession, path: str, each: Callable[[np.ndarray], object], kind: pa.DataType, sql_kind: str) -> DataFrame:
    """doc_id, start, n_tokens and value = each(ids), read back from the files."""

    @K.frugal
    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            for names, ends, bits, payload, start in zip(rows["doc_ids"], rows["ends"], rows["bits"], rows["payload"], rows["start"], strict=True):
                ids = unpack(payload, bits, 0, ends[-1])
                begin = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([start + x for x in begin], pa.int64()), pa.array([e - x for x, e in zip(begin, ends, strict=True)], pa.int64()), pa.array([each(ids[x:e]) for x, e in zip(begin, ends, strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", "value"],
                )

    return read_blocks(spark, path).select("doc_ids", "ends", "bits", "payload", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, value {sql_kind}")


def token_digest(docs: DataFrame, *, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write docs' tokens, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path=tokenizer_path, **options)
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return map_documents(spark, path, crc, pa.int64(), "long").withColumnRenamed("value", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and value: the ids as an array."""
    return map_documents(spark, path, lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()), "array<bigint>")
