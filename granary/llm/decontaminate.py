"""Benchmark decontamination: passages of the corpus as queries against a BM25 index of the test items.

The items are indexed, the corpus is streamed past the index: there is no shuffle. A text is cut into
overlapping passages, twice as long as the longest item and half overlapping, so that an item lies whole in
one of them. Each passage asks for all items that score at least THRESHOLD of what the item scores for its own
text. Retrieval is block-max WAND over impacts that are divided by the items' own scores; passages that cannot
reach the threshold are told beforehand by an upper bound, an item's essential terms seen plus all of its
others. A hit is then verified on words: OVERLAP of the question's and of the answer's distinct 5-word shingles
(the whole sequence as one if shorter) must stand in the passage. The answer is an item's last line, or its last
sentence if it has one line, or nothing if it has one sentence; then the question is all of it.

Statistics (number of items, their mean and greatest length, document frequencies) are those of all items and are computed in
Spark; the index is a broadcast of at most SHARD_ITEMS items with the frequencies of their own terms. More items are
dealt into shards by a hash, equal ones once. A shard sees each batch of the corpus in turn, so texts are read once and hits do
not depend on the size of shards. Words are compared with A-Z in lower case and without ASCII punctuation at their ends.

Null or empty texts and items match nothing; repeated documents are judged alike, repeated items are one; other columns are
ignored; ids may repeat or be null; an empty table of either kind gives no hits. Very long texts are read whole, passage by
passage. Of passages with equal scores for an item the first is told.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch

SHINGLE = 5
OVERLAP = 0.75
THRESHOLD = 0.5
#: Share of an item's own score that its inessential terms may make up.
INESSENTIAL = 0.15
K1, B = 1.2, 0.75
BLOCK = 32
SHARD_ITEMS = 50_000


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def words_of(text: str | None) -> list[bytes]:
    return [w for x in raw_words(text) if (w := x.strip(PUNCTUATION))]


class Terms(dict):
    """Raw word to its term, -1 for none; forgets strangers when it grows large."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = k = self.terms.get(word.strip(PUNCTUATION), -1)
        return k

    def __reduce__(self):
        return Terms, (self.terms,)


def shingle_set(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return words_of(" ".join(lines[:-1])), words_of(lines[-1])
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (words_of(" ".join(parts[:-1])), words_of(parts[-1])) if len(parts) > 1 else (words_of(text), [])


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many, their mean and greatest number of words, and in how many each term is."""

    items: int
    mean: float
    longest: int
    frequencies: dict[bytes, int]


def statistics_of(texts: Iterable[str | None]) -> Statistics:
    found = [w for t in texts if (w := words_of(t))]
    return Statistics(len(found), sum(map(len, found)) / max(1, len(found)), max(map(len, found), default=1), Counter(w for ws in found for w in set(ws)))


class Index:
    """Postings with impacts: a term's BM25 weight in an item over the item's own score. statistics: of all items, if these are a part of them."""

    def __init__(self, items: list[tuple[int | None, str | None]], statistics: Statistics | None = None):
        told = statistics or statistics_of(t for _, t in items)
        found = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, *_ in found]
        self.parts = [question_and_answer(t) for _, t, _ in found]
        n, mean = len(found), told.mean
        self.passage = 2 * told.longest
        df = Counter(w for *_, ws in found for w in set(ws))
        idf = {w: np.log(1 + (told.items - c + 0.5) / (c + 0.5)) for w in df for c in (told.frequencies[w],)}
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        self.lookup = Terms(self.terms)
        postings, essential, self.rest = defaultdict(list), defaultdict(list), np.zeros(n)
        for i, (*_, ws) in enumerate(found):
            tf = Counter(ws)
            weight = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            own = sum(weight.values())
            left = 1.0
            for w, x in sorted(weight.items(), key=lambda wx: (-wx[1], wx[0])):
                postings[self.terms[w]].append((i, x / own))
                if left > INESSENTIAL:
                    essential[self.terms[w]].append((i, x / own))
                    left -= x / own
            self.rest[i] = max(left, 0.0)
        self.postings, self.block_max, self.last = {}, {}, {}
        for t, entries in postings.items():
            entries.sort()
            at, impact = [i for i, _ in entries], [x for _, x in entries]
            self.postings[t] = (at, impact)
            self.block_max[t] = [max(impact[k : k + BLOCK]) for k in range(0, len(at), BLOCK)]
            self.last[t] = [at[min(k + BLOCK, len(at)) - 1] for k in range(0, len(at), BLOCK)]
        counts = [len(essential[t]) for t in range(len(self.terms))]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        flat = [e for t in range(len(self.terms)) for e in essential[t]]
        self.items_of = np.array([i for i, _ in flat], np.int64)
        self.impact_of = np.array([x for _, x in flat])

    def passages(self, known: np.ndarray, n: int) -> list[int]:
        """Numbers of the passages of a text that may hold an item; known: its words' terms, -1 for none."""
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return []
        stride = self.passage // 2
        windows = at // stride
        keys = np.unique(np.concatenate([windows, np.maximum(windows - 1, 0)]) * len(self.terms) + np.concatenate([known[at], known[at]]))
        window, term = np.divmod(keys, len(self.terms))
        counts = self.first[term + 1] - self.first[term]
        total = int(counts.sum())
        if not total:
            return []
        entry = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[term], counts)
        cell, back = np.unique(np.repeat(window, counts) * len(self.ids) + self.items_of[entry], return_inverse=True)
        seen = np.bincount(back, weights=self.impact_of[entry])
        return np.unique(cell[seen + self.rest[cell % len(self.ids)] >= THRESHOLD - 1e-9] // len(self.ids)).tolist()

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """All (item, score) of at least THRESHOLD, by block-max WAND."""
        lists = [(self.postings[t], self.block_max[t], self.last[t]) for t in terms]
        place = [0] * len(lists)
        out = []
        while True:
            alive = sorted((k for k in range(len(lists)) if place[k] < len(lists[k][0][0])), key=lambda k: lists[k][0][0][place[k]])
            bound, pivot = 0.0, None
            for n, k in enumerate(alive):
                bound += max(lists[k][1][place[k] // BLOCK :])
                if bound >= THRESHOLD - 1e-9:
                    pivot = lists[k][0][0][place[k]]
                    break
            if pivot is None:
                return out
            ahead = [k for k in alive if lists[k][0][0][place[k]] <= pivot]
            near, end = 0.0, None
            for k in ahead:
                b = bisect_left(lists[k][2], pivot)
                if b < len(lists[k][2]):
                    near += lists[k][1][b]
                    end = lists[k][2][b] if end is None else min(end, lists[k][2][b])
            others = [lists[k][0][0][place[k]] for k in alive if k not in ahead]
            if near < THRESHOLD - 1e-9:
                # No item up to the end of these blocks, or to the next list's first item, can score enough.
                to = min([pivot if end is None else end, *(o - 1 for o in others)]) + 1
                to = max(to, pivot + 1)
            else:
                score = 0.0
                for k in ahead:
                    at, impact = lists[k][0]
                    p = bisect_left(at, pivot, place[k])
                    if p < len(at) and at[p] == pivot:
                        score += impact[p]
                if score >= THRESHOLD - 1e-9:
                    out.append((pivot, score))
                to = pivot + 1
            for k in ahead:
                place[k] = bisect_left(lists[k][0][0], to, place[k])

    def hits(self, text: str | None) -> list[tuple[int, float, int, float, float]]:
        """(item, score, first word of the passage, overlap of the question, of the answer): the best verified passage per item."""
        words = raw_words(text)
        if not words or not self.ids:
            return []
        known = np.fromiter(map(self.lookup.__getitem__, words), np.int64, len(words))
        stride, best = self.passage // 2, {}
        for window in self.passages(known, len(words)):
            part = slice(window * stride, window * stride + self.passage)
            terms = set(known[part].tolist()) - {-1}
            have = None
            for i, score in self.retrieve(terms):
                have = [w for x in words[part] if (w := x.strip(PUNCTUATION))] if have is None else have
                shares = [overlap(p, have) for p in self.parts[i]]
                if shares[0] >= OVERLAP and shares[1] >= OVERLAP and (i not in best or score > best[i][1]):
                    best[i] = (i, score, part.start, *shares)
        return [best[i] for i in sorted(best)]


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of a part's shingles that stand in the passage; 1 for an empty part."""
    if not part:
        return 1.0
    size = min(SHINGLE, len(part))
    want = shingle_set(part)
    have = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
    return len(want & have) / len(want)


def _item_words(batches):
    for batch in batches:
        words = [words_of(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": pa.array(map(len, words), pa.int64()), "terms": pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))})


def shards(items: DataFrame, id_col: str, text_col: str, shard_items: int) -> list[Broadcast]:
    """Broadcasts of (name, items, their statistics), each of about shard_items items at most; indexes are built where they are used."""
    spark, scratch = items.sparkSession, Scratch(items.sparkSession)
    rows = scratch.table(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct(), "items")
    words = scratch.table(rows.select("text").mapInArrow(_item_words, "n long, terms array<binary>").where("n > 0"), "words")
    number, total, longest = words.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if not number:
        return []
    frequencies = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n, out = -(-number // shard_items), []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        own = part.select("text").mapInArrow(_item_words, "n long, terms array<binary>").select(F.explode("terms").alias("term")).distinct()
        told = {bytes(r.term): r.df for r in frequencies.join(own, "term", "left_semi").collect()}
        found = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, found, Statistics(number, total / number, longest, told))))
    scratch.drop("items", "words")
    return out


_built: dict[str, Index] = {}


def _index(shard: Broadcast) -> Index:
    """The index of a shard, built once a worker as long as no other is asked for."""
    name, items, statistics = shard.value
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, statistics)
    return _built[name]


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, first_word of the passage, overlaps."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    found = shards(items, "item_id", "text", shard_items)

    def run(batches, found=found):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for shard in found:
                index = _index(shard)
                hits = [(d, index.ids[i], *rest) for d, t in zip(ids, texts, strict=True) for i, *rest in index.hits(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in hits], HITS.field(k).type) for k in range(len(HITS))], schema=HITS)

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double")


def drop_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found, place = shards(items, "item_id", "text", shard_items), docs.columns.index(text_col)

    def run(batches, found=found, place=place):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            clean = [True] * len(texts)
            for shard in found:
                index = _index(shard)
                clean = [c and not index.hits(t) for c, t in zip(clean, texts, strict=True)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
