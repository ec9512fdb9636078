"""Line deduplication with log templates.

Lines are parsed as log messages by a tree of fixed depth. A line's leaf is its number of tokens and its first
DEPTH tokens, tokens with a digit generalised. Inside a leaf, a token is constant at its place if the lines that have it
there come to MIN_DOCS, each line counted once for each text that has it; others are variable. A line whose places are
at least CONSTANT constant belongs to the template of its constant tokens, any other line is a template of its own.
A template that recurs in MIN_DOCS documents is dropped with all its lines; lines under SHORT tokens, which recur by
themselves in running text, need SHORT_SHARE of all texts besides.

Copies of a document share all their lines without any of them being boilerplate, so copies count as one document:

- equal texts are one;
- edited copies agree in what stands around the line. Each line comes with SKETCHES minima, those of the 5-word shingles
  of all other lines of its text. A value that two texts of one template have is common to it; a text with ATTACHED or
  more common values is an edited copy. Of two texts that are similar to three quarters, so many minima agree with a
  probability of 0.996, whichever line is looked at; of texts that only share the line, none do. Texts with nothing but the
  line are copies. Copies are counted by the
  commonest value of each: a group of two has one, larger ones have more, up to SKETCHES and a few, so a value counts for
  a share that falls with its texts. ERROR of the copies, the sketch's share of misses, is taken off the other texts.

How it runs: one pass over the texts stores the lines as token hashes; leaves with enough texts are few and reduce all
later steps to their lines. Constant tokens are found over distinct lines and joined to them by (leaf, place, token).
Counting is by keys with map-side sums: a line in a third of all documents costs a row per distinct text and task. Only documents
with a dropped line are rewritten.

Lines are split at \\n, tokens at ASCII white space. Null or empty texts have no lines to drop and stay as they are.
Repeated rows count as copies of one document. A text that loses all its lines with words becomes empty; clean_lines
leaves such rows out if asked. Other columns are kept, whatever their names; ids may repeat or be null; an empty table
gives no rows. Very long texts are read whole, a text at a time; short ones are parsed some at a time. Nothing here depends on an order, so there are no ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from granary.llm.common import Scratch, broadcast_if_small, give_back
from granary.llm.neardup import SHINGLE, WordHashes, mix

DEPTH = 3
MIN_DOCS = 5
CONSTANT = 0.5
SHORT = 3
SHORT_SHARE = 0.001
SKETCHES = 8
ATTACHED = 3
ERROR = 0.005
SMALL = 500_000
#: Characters of texts that are parsed together.
TOGETHER = 65_536

_DIGIT = re.compile(rb"[0-9]").search
_P = np.uint64(0x9E3779B97F4A7C15)
_ANY = 0x5851F42D4C957F2D
_RNG = np.random.Generator(np.random.PCG64(4711))
_A = _RNG.integers(0, 1 << 31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)
_MOST = np.uint32(0xFFFFFFFF)


class TokenHashes(WordHashes):
    """Token to hash; tokens with a digit are all the variable token."""

    def __missing__(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word) if word.isalpha() or not _DIGIT(word) else _ANY
        if len(self) > 400_000:
            self.clear()
        self[word] = h
        return h


def sketches(tokens: np.ndarray, start: np.ndarray, sizes: np.ndarray, line: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per line the SKETCHES minima of the shingles of its text's other lines, 32 bits each; equal lines are one line. text: growing numbers of the texts."""
    n = max(1, len(tokens) - SHINGLE + 1)
    runs = tokens[:n].copy()
    for k in range(1, min(SHINGLE, len(tokens))):
        runs *= _P
        runs += tokens[k : k + n]
    # Shingles lie in one line; a line with fewer tokens is one of its own, told by its hash.
    count = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.cumsum(count) - count
    value = runs[np.minimum(np.arange(int(count.sum())) + np.repeat(start - first, count), n - 1)]
    few = sizes < SHINGLE
    value[first[few]] = line[few]
    value = (mix(value) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
    owner = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(text)))
    lines = np.arange(len(sizes))
    out = np.empty((len(sizes), SKETCHES), np.uint32)
    step = max(1, min(SKETCHES, 1_000_000 // len(value)))
    for k in range(0, SKETCHES, step):
        h = value ^ _B[k : k + step, None]
        h *= _A[k : k + step, None]
        least = np.minimum.reduceat(h, first, axis=1)
        most = np.minimum.reduceat(least, begin, axis=1)[:, owner]
        # The first line that has its text's minimum, and lines equal to it, have the minimum of the others.
        at = np.minimum.reduceat(np.where(least == most, lines, len(lines)), begin, axis=1)
        own = line == line[at][:, owner]
        others = np.minimum.reduceat(np.where(own, _MOST, least), begin, axis=1)[:, owner]
        out[:, k : k + step] = np.where(own, others, most).T
    return out


def parse(texts: list[str | None], known: TokenHashes) -> tuple[np.ndarray, ...]:
    """Per line with tokens: the place of its text, its number there, its leaf, its hash and its number of tokens; further all tokens and each line's sketches."""
    split = [(text or "").encode().split(b"\n") for text in texts]
    parts = [line.split() for lines in split for line in lines]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    text = np.repeat(np.arange(len(split)), counts)
    number = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    kept = np.flatnonzero(sizes)
    text, number, sizes = text[kept], number[kept], sizes[kept]
    n = int(sizes.sum())
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.view(np.uint64), np.zeros((0, SKETCHES), np.uint32)
    tokens = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.uint64, n)
    start = np.cumsum(sizes) - sizes
    leaf = sizes.astype(np.uint64)
    for k in range(DEPTH):
        leaf = leaf * _P + tokens[start + np.minimum(k, sizes - 1)]
    place = (np.arange(n) - np.repeat(start, sizes)).astype(np.uint64)
    whole = np.add.reduceat(mix(tokens + place * _P), start)
    line = mix(whole + leaf)
    return text, number, mix(leaf).view(np.int64), line.view(np.int64), sizes, tokens, sketches(tokens, start, sizes, line, text)


LINES = "doc long, copy long, number int, leaf long, line long, sketch array<int>, tokens array<long>"


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts of TOGETHER characters or little more."""
    first = chars = 0
    for k, text in enumerate(texts, 1):
        chars += len(text or "")
        if chars >= TOGETHER or k == len(texts):
            yield first, k
            first, chars = k, 0


def _lines(batches):
    known = TokenHashes()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        found, texts = [], batch.column(2).to_pylist()
        doc, copy = (batch.column(k).to_numpy() for k in range(2))
        for a, b in _together(texts):
            text, number, leaf, line, sizes, tokens, sketch = parse(texts[a:b], known)
            found.append((doc[a + text], copy[a + text], number, leaf, line, sketch.view(np.int32).ravel(), sizes, tokens.view(np.int64)))
        *columns, sketch, sizes, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)) for n, flat in ((np.full(len(sizes), SKETCHES), sketch), (sizes, tokens))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)] + lists, names=["doc", "copy", "number", "leaf", "line", "sketch", "tokens"])
    known.clear()
    give_back()


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(text_col))


def _templates(lines: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """(line, template) of the distinct lines."""
    texts = lines.select("leaf", "line", "copy").distinct().groupBy("leaf", "line").agg(F.count("*").alias("c"))
    tokens = lines.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    once = scratch.table(tokens.join(texts, ["leaf", "line"]), "once")
    cells = once.select("leaf", "line", "c", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= DEPTH)
    constant = scratch.table(cells.groupBy("leaf", "at", "token").agg(F.sum("c").alias("c")).where(F.col("c") >= min_docs).select("leaf", "at", "token"), "constant")
    kept = cells.join(broadcast_if_small(constant, SMALL), ["leaf", "at", "token"], "left_semi")
    # The tokens of a pattern in any order: their hashes are added up.
    cell = F.xxhash64("at", "token").cast("decimal(38,0)")
    pattern = scratch.table(kept.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.sum(cell).alias("pattern")), "pattern")
    joined = once.join(pattern, ["leaf", "line"], "left")
    fixed = F.least(F.size("tokens"), F.lit(DEPTH)) + F.coalesce("n", F.lit(0))
    general = F.col("n").isNotNull() & (fixed >= CONSTANT * F.size("tokens"))
    out = joined.select("line", F.when(general, F.xxhash64("leaf", F.col("pattern").cast("string"))).otherwise(F.col("line")).alias("template"), (F.size("tokens") < SHORT).alias("short"))
    return scratch.table(out, "templates")


def _recurring(told: DataFrame, min_docs: int, min_short: float, scratch: Scratch) -> DataFrame:
    """(template) of the templates that enough documents have, copies counted as one. told: template, short, copy, sketch; a row per template and text."""
    many = told.groupBy("template").agg(F.count("*").alias("c"), F.first("short").alias("short"))
    many = scratch.table(many.where((F.col("c") >= min_docs) & (~F.col("short") | (F.col("c") >= min_short))).select("template"), "many")
    told = scratch.table(told.join(broadcast_if_small(many, SMALL), "template", "left_semi").select("template", "copy", "sketch"), "among")
    values = told.select("template", "copy", F.posexplode("sketch").alias("k", "value"))
    common = scratch.table(values.groupBy("template", "k", "value").agg(F.count("*").alias("c")).where(F.col("c") > 1), "common")
    hits = values.join(broadcast_if_small(common, SMALL), ["template", "k", "value"]).groupBy("template", "copy")
    hits = hits.agg(F.count("*").alias("hits"), F.max(F.struct("c", "k", "value")).alias("most")).where(F.col("hits") >= ATTACHED)
    attached = scratch.table(hits.select("template", "most"), "attached")
    groups = attached.distinct().groupBy("template").agg(F.sum(1 / F.least(F.ceil(F.col("most.c") / 2), F.lit(2 * SKETCHES))).alias("groups"))
    copies = attached.groupBy("template").agg(F.count("*").alias("copies"))
    texts = told.groupBy("template").agg(F.count("*").alias("texts"))
    counted = texts.join(copies, "template", "left").join(groups, "template", "left").fillna(0)
    alone = F.greatest(F.col("texts") - F.col("copies") - F.ceil(ERROR * F.col("copies")), F.lit(0))
    sources = alone + F.ceil(F.round("groups", 6))
    out = scratch.table(counted.where(sources >= min_docs).select("template"), "recurring")
    scratch.drop("many", "among", "common", "attached")
    return out


def dropped_lines(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, numbers): by row key, the numbers of the lines to drop."""
    scratch = Scratch(spark)
    every = scratch.table(docs.select(_key(id_col, text_col), F.xxhash64(text_col, F.length(text_col)), text_col).mapInArrow(_lines, LINES), "every")
    texts = every.select("copy").distinct().count()
    pairs = every.select("leaf", "copy").distinct()
    leaves = scratch.table(pairs.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf"), "leaves")
    lines = scratch.table(every.join(broadcast_if_small(leaves, SMALL), "leaf"), "lines")
    scratch.drop("every")
    told = lines.select("doc", "copy", "number", "line", "sketch").join(broadcast_if_small(_templates(lines, min_docs, scratch), SMALL), "line")
    told = scratch.table(told.select("doc", "copy", "number", "template", "short", "sketch"), "told")
    once = told.groupBy("template", "copy").agg(F.first("short").alias("short"), F.min("sketch").alias("sketch"))
    recurring = _recurring(once, min_docs, SHORT_SHARE * texts, scratch)
    scratch.drop("lines", "once", "constant", "pattern", "templates")
    out = told.join(broadcast_if_small(recurring, SMALL), "template").groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    out = scratch.table(out, "out")
    scratch.drop("told", "recurring", "leaves")
    return out


def _has_words(line: Column) -> Column:
    return line.rlike(r"[^ \x09-\x0D]")


def clean_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, leave_out_emptied: bool = False) -> DataFrame:
    """docs with the recurring lines gone from text_col and a column more: struct `__lines` (total, dropped)."""
    found = dropped_lines(spark, docs, id_col, text_col, min_docs)
    key, gone = "__granary_doc", "__granary_numbers"
    joined = docs.withColumn(key, _key(id_col, text_col)).join(broadcast_if_small(found.withColumnRenamed("doc", key).withColumnRenamed("numbers", gone), SMALL), key, "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    total = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    counts = F.struct(total.cast("long").alias("total"), F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("dropped"))
    out = joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], counts.alias("__lines"))
    if leave_out_emptied:
        out = out.where((F.col("__lines.dropped") == 0) | _has_words(F.col(text_col)))
    return out


def line_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, n_chars and SHA-256 of the text that is left."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = clean_lines(spark, rows, "doc_id", "text", min_docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines.total").alias("n_lines"), F.col("__lines.dropped").alias("n_dropped"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
