"""Blocks of documents with a dictionary of their distinct words.

Work that depends on a word alone (counting or listing its tokens) is done once per distinct word of the
corpus. What connects words and documents are blocks: a run of documents of one input partition, up to
BLOCK_CHARS characters. A block's dictionary lists its distinct words, frequent ones first; its documents are one
row of packed places in that dictionary. Dictionaries are cut into buckets by a hash of the word, and a bucket's
words from all blocks meet in one task, which has no other bucket. So the shuffles carry each distinct word of a block
once, and a word that every document has costs one entry per block.

The texts are read once. Blocks are stored bucketed by name, so that the words' values come back to them without
a shuffle of the packed texts. A block is named by a digest of its content; blocks of equal content have equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, give_back

#: Characters after which a block ends; bounds a task's memory.
BLOCK_CHARS = 8_000_000

#: Characters of the corpus for each bucket of words; bounds the words that meet in one task.
BUCKET_CHARS = 8_000_000

Split = Callable[[str], list[str]]



def _squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def pack(numbers: np.ndarray) -> list[bytes]:
    """Whole numbers below 2^29, most of them small: one byte each, the rest of the larger ones by byte plane."""
    large = numbers >= 192
    low = np.where(large, 192 + ((numbers - 192) & 31), numbers).astype(np.uint8)
    high = ((numbers[large] - 192) >> 5).astype("<u4")
    planes = np.ascontiguousarray(high).view(np.uint8).reshape(-1, 4).T
    return [_squeeze(low), _squeeze(np.ascontiguousarray(planes))]


def unpack(body: list[bytes]) -> np.ndarray:
    low, planes = (np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for b in body)
    out = low.astype(np.int64)
    large = out >= 192
    high = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    out[large] += high << 5
    return out


class Places(dict):
    """Word to place, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _runs(batches: Iterator[pa.RecordBatch], split: Split, mark: Callable[[str], bytes] | None = None) -> Iterator[tuple]:
    def fresh():
        return hashlib.blake2b(digest_size=8), Places(), [], [], [], []

    digest, places, ids, sizes, marks, seqs = fresh()
    chars = 0
    for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            text = text or ""
            raw = text.encode()
            digest.update(repr((key, len(raw))).encode())
            digest.update(raw)
            words = split(text)
            seqs.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            ids.append(key)
            sizes.append(len(raw))
            marks.append(mark(text) if mark else b"")
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield _ranked(digest, places, seqs) + (ids, sizes, marks)
                (digest, places, ids, sizes, marks, seqs), chars = fresh(), 0
    if ids:
        yield _ranked(digest, places, seqs) + (ids, sizes, marks)


def _ranked(digest, places: Places, seqs: list[np.ndarray]) -> tuple[int, list[str], list[np.ndarray]]:
    """Name of the block, its words with the frequent ones first (ties: first appearance), its texts as places in them."""
    counts = np.bincount(np.concatenate(seqs), minlength=len(places))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words = list(places)
    return int.from_bytes(digest.digest(), "little", signed=True), [words[k] for k in order.tolist()], [rank[s] for s in seqs]


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets for the words of docs, in proportion to their characters."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return 1 + chars // BUCKET_CHARS


def bucket_names(spark: SparkSession, n: int) -> np.ndarray:
    """Names of n buckets, which Spark's hash deals out to n partitions one by one.

    Numbers in order would meet by chance: of 13 buckets in 12 partitions, three or four are often one task's.
    """
    tried = 32 * n
    while True:
        found = spark.range(0, tried, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("k")).agg(F.min("id").alias("id")).collect()
        if len(found) == n:
            return np.array(sorted(r["id"] for r in found), np.int64)
        tried *= 2


def _buckets(words: list[str], n: int) -> np.ndarray:
    return np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words)) % n


STORED = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.list_(pa.string()))]
    + [("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("buckets", pa.list_(pa.binary())), ("body", pa.list_(pa.binary()))]
)
STORED_SQL = "block long, bucket long, words array<string>, ids array<long>, n_bytes array<long>, marks array<binary>, lengths array<int>, buckets array<binary>, body array<binary>"


def store(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, split: Split, counted: bool, mark: Callable[[str], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stores the blocks of docs. Gives a row per block with its documents, and a row per block and bucket with its words, dealt by bucket.

    A document is its words' places in order; or, if counted, its distinct places as differences and then their counts.
    mark: kept per text.
    """
    names = bucket_names(docs.sparkSession, bucket_count(docs, text_col))

    def batch(**columns) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in STORED], schema=STORED)

    def run(batches):
        for block, words, seqs, ids, sizes, marks in _runs(batches, split, mark):
            bucket = _buckets(words, len(names))
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            flat, offsets = pa.array(words, pa.string()).take(pa.array(order)), pa.array([*first, len(order)], pa.int32())
            yield batch(block=np.full(len(found), block), bucket=names[found], words=pa.ListArray.from_arrays(offsets, flat))
            if counted:
                seqs = [np.concatenate([np.diff(at.astype(np.int64), prepend=0), n]) for at, n in (np.unique(s, return_counts=True) for s in seqs)]
            yield batch(block=[block], ids=[ids], n_bytes=[sizes], marks=[marks], lengths=[[len(s) for s in seqs]], buckets=[pack(bucket)], body=[pack(np.concatenate(seqs))])
            del words, seqs, ids, sizes, marks, bucket, order, flat
            give_back()

    blocks = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, STORED_SQL)
    stored = scratch.bucketed(blocks, "blocks", "block", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Words are read without the buckets: plans that use them twice then share their exchange.
    plain = docs.sparkSession.read.schema(STORED_SQL).parquet(scratch.paths["blocks"])
    words = plain.where("bucket IS NOT NULL").select("bucket", "block", "words").repartition(len(names), "bucket")
    return stored.where("bucket IS NULL").drop("bucket", "words"), words


class Values:
    """What each word of a block stands for: runs of numbers, kept end to end."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat, self.starts = sizes, flat, np.cumsum(sizes) - sizes

    def of(self, places: np.ndarray) -> np.ndarray:
        """The runs of a sequence of words, end to end."""
        n = self.sizes[places]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - n), n)
        return self.flat[at]


def assemble(blocks: DataFrame, values: DataFrame, unpack_values: Callable, each: Callable, schema: str, chunk: int = 100) -> DataFrame:
    """Brings the words' values to the documents' blocks.

    values: (bucket, block, body), where unpack_values(body) gives (sizes, flat): for each of the words that the
    bucket has of the block how many numbers it stands for, and these. each(ids, n_bytes, marks, list of arrays of
    places, Values by place) gives a record batch for some documents of a block, chunk at a time.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # Blocks of equal content share their name and so have the same words.
        found = {b: unpack_values(body) for b, body in zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True)}
        out = []
        for k in range(left.num_rows):
            cell = lambda c: left[c][k]  # noqa: B023, E731
            bucket = unpack(cell("buckets").as_py())
            order = np.argsort(bucket, kind="stable")
            # Names grow with the numbers that are packed.
            parts = [found[b] for b in sorted(found)]
            none = np.zeros(0, np.int64)
            sizes, flat = (np.concatenate([p[k] for p in parts] or [none]) for k in range(2))
            by_bucket = Values(sizes, flat)
            value = Values(np.zeros(len(order), np.int64), flat)
            value.sizes[order], value.starts[order] = by_bucket.sizes, by_bucket.starts
            places, ends = unpack(cell("body").as_py()), np.cumsum(cell("lengths").values.to_numpy())
            ids, n_bytes, marks = (cell(c).values for c in ("ids", "n_bytes", "marks"))
            for a in range(0, len(ends), chunk):
                cut = ends[a : a + chunk]
                first = ends[a - 1] if a else 0
                out.append(each(ids[a : a + chunk], n_bytes[a : a + chunk], marks[a : a + chunk], np.split(places[first : cut[-1]], cut[:-1] - first), value))
        give_back()
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)
