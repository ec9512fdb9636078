"""Near-duplicate documents by MinHash and an LSH forest.

A document's set holds its distinct 5-word shingles (ASCII letters in lower case; the whole sequence as one
with fewer words; nothing without words). Documents are linked if 100 * intersection >= 75 * union, and each
link is confirmed on the full sets. The steps:

1. Signatures: HASHES minima a document, in one pass without a shuffle.
2. Documents with equal sets become one class; only one row of a class goes on. Copies of any number cost no more.
3. Forest: ORDERS sorted orders of the signatures, each begun at another hash. Rows of an order that share their
   first FLOOR values are a region. In regions of up to CROWD rows all pairs are candidates; larger ones are
   crowded. Orders are range-partitioned by their full labels, so a region of any size is spread over tasks; the
   rows at partition borders are compared in a second small pass.
4. Crowded regions are mostly edited copies of one text, which are closer to that text than to each other. The
   text's own label is the commonest one of the region in every order. So each member is a candidate with the row
   that is most often among the commonest labels of its regions: pairs grow with the region, not with its square.
5. Where this does not make a crowded region one component, its other links are found exactly, through what each row
   has beyond that central row's set or lacks of it, its difference. Two rows linked with the central row need no
   test. For any other pair, sizes of sets and differences tell how much of its differences a link must share, and
   that is never nothing; so linked rows share a value in the first part of their differences (a prefix filter), whatever the
   order. Values of one row only are left out, and those of few rows come first: a template that all rows hold is in no
   difference, and one that many hold comes last. Rows that share a value are candidates if enough can still follow behind it.
6. Candidates whose set sizes allow a link are confirmed on full texts in three rounds: first the pairs with the
   central row and each document's smallest neighbour, then the smallest neighbour in another component, then
   whatever pairs still lie across components. Pairs inside a component need no test, as they change nothing.
7. Components by alternating stars. Nothing of the corpus goes to the driver.

Documents are known by doc_id: rows that share an id count as one node with either text, and all are kept or
none. A null id is linked with nothing and kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from granary.llm.common import Scratch, broadcast_if_small, give_back, is_small
from granary.llm.links import components

SHINGLE = 5
HASHES = 96
ORDERS = 24
FLOOR = 3
LEVELS = 12
CROWD = 8
SMALL = 2_000_000

_MASK = (1 << 64) - 1
_HALF, _FIRST, _SECOND = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_RNG = np.random.Generator(np.random.PCG64(20_240_601))
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash; forgets when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> _HALF
    h *= _FIRST
    h ^= h >> _HALF
    h *= _SECOND
    h ^= h >> _HALF
    return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of so many words, in order; one of all words if there are fewer."""
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    width = min(size, len(w))
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return mix(out)


def minima(values: np.ndarray) -> np.ndarray:
    """The signature of a set of hashes."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(values), 1024):
        part = (values[k : k + 1024, None] * _A + _B) >> np.uint64(32)
        np.minimum(best, part.min(axis=0), out=best)
    return best.astype(np.uint32)


def _sign(batches):
    known = WordHashes()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
    for batch in batches:
        sizes, digests, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            values = np.unique(shingles(word_hashes(text, known)))
            sizes.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            sigs.append(minima(values).tobytes() if len(values) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)
    known.clear()
    give_back()


LABELS = pa.schema([("label", pa.binary()), ("node", pa.int64()), ("n", pa.int64())])
LABELS_SQL = "label binary, node long, n long"


def _labels(batches):
    stride = HASHES // ORDERS
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint16)
        for order in range(ORDERS):
            part = np.roll(sigs, -order * stride, axis=1)[:, :LEVELS].astype(">u2")
            rows = np.empty((len(nodes), 1 + 2 * LEVELS), np.uint8)
            rows[:, 0] = order
            rows[:, 1:] = np.ascontiguousarray(part).view(np.uint8).reshape(len(nodes), -1)
            data = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([data, pa.array(nodes), pa.array(sizes)], schema=LABELS)


VALUES = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("hub", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("least", pa.int64()), ("far", pa.bool_())])
VALUES_SQL = "key long, node long, hub long, c long, n long, d long, least long, far boolean"
_SALT = np.uint64(0x2545F4914F6CDD1D)


def difference(values: np.ndarray, central: np.ndarray) -> np.ndarray:
    """What a set has beyond a central one, then what it lacks of it, each in order of hash; the two are told apart by a salt."""
    return np.concatenate([np.setdiff1d(values, central, assume_unique=True), mix(np.setdiff1d(central, values, assume_unique=True) ^ _SALT)])


def least_shared(n: int, d: int, central: int, far: bool) -> int:
    """What a row's difference must at least share with that of a linked row, if not both are linked with the central row.

    Sets of x and y values whose differences have d and e values are linked if these share (d + e - (x + y) / 7) / 2.
    A far row has 7 e > y + central, and any row 7 e - y >= -central. As no more than e can be shared, it is at least
    d - (x + y) / 7 too, and y is at most 4 x / 3.
    """
    two = 7 * d - n + (central if not far else -central)  # 14 times what is shared is more than this, or this much if the row is far
    return max(1, two // 14 + 1 if not far else -(-two // 14), -(-(3 * d - n) // 3))


def _differences(batches):
    """(node, c, hub, c_hub, text, hub_text) to the values of the node's difference by key; or key null: a pair of node and hub to test."""
    known = WordHashes()
    hubs: dict[int, np.ndarray] = {}
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        out: list[list[np.ndarray]] = [[] for _ in VALUES]
        pairs = []
        for node, c, hub, c_hub, text, hub_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hub not in hubs:
                if len(hubs) > 256:
                    hubs.clear()
                hubs[hub] = np.unique(shingles(word_hashes(hub_text, known)))
            values, central = np.unique(shingles(word_hashes(text, known))), hubs[hub]
            diff = difference(values, central)
            n, d = len(values), len(diff)
            far = 7 * d > n + len(central)
            if not far and c != c_hub:
                pairs.append((node, hub))
            least = least_shared(n, d, len(central), far)
            if least > d:
                continue
            with np.errstate(over="ignore"):
                key = mix(diff ^ mix(np.full(1, hub, np.int64).view(np.uint64) * _SALT)).view(np.int64)
            for column, x in zip(out, (key, *(np.full(d, v) for v in (node, hub, c, n, d, least, far))), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip(out, VALUES, strict=True)], schema=VALUES)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()) if f.name == "node" else pa.array([p[1] for p in pairs], pa.int64()) if f.name == "hub" else pa.nulls(len(pairs), f.type) for f in VALUES], schema=VALUES)
    known.clear()
    hubs.clear()
    give_back()


def _sharing(batches):
    """Values sorted by key, far rows first: (a, b) that share one and can share enough, of different components and not both near."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: tuple):
        node, c, n, d, rest, far = rows
        if len(node) < 2 or not far[0] or (c == c[0]).all():
            return
        m = int(far.sum())
        step = max(1, 1_000_000 // len(node))
        for k in range(0, m, step):
            x, y = slice(k, min(k + step, m)), slice(k, None)
            side = lambda v: (v[x, None], v[None, y])  # noqa: B023, E731
            (dx, dy), (nx, ny), (rx, ry), (cx, cy) = side(d), side(n), side(rest), side(c)
            ok = (cx != cy) & _size_ok(nx, ny) & (14 * np.minimum(rx, ry) >= 7 * (dx + dy) - nx - ny)
            i, j = np.nonzero(ok)
            if len(i):
                p, q = node[x][i], node[y][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], schema=schema)

    carry = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            rows = tuple(batch.column(f).to_numpy(zero_copy_only=False) for f in ("key", "node", "c", "n", "d", "rest", "far"))
            carry = rows if carry is None else tuple(np.concatenate(x) for x in zip(carry, rows, strict=True))
        if carry is None:
            return
        begin = np.concatenate([[0], np.flatnonzero(carry[0][1:] != carry[0][:-1]) + 1, [len(carry[0])]])
        # The last key may go on in the next batch.
        done = len(begin) - 1 if batch is None else len(begin) - 2
        for k in np.flatnonzero(np.diff(begin[: done + 1]) > 1).tolist():
            yield from pairs(tuple(x[begin[k] : begin[k + 1]] for x in carry[1:]))
        carry = tuple(x[begin[done] :] for x in carry)


PREFIX = 1 + 2 * FLOOR
WIDTH = 1 + 2 * LEVELS
OUT = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("label", pa.binary()), ("n", pa.int64())])


def _size_ok(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(x, y) >= 75 * np.maximum(x, y)


def _neighbours(borders: bool):
    """Rows sorted by label: the pairs of regions that are not crowded, crowded rows, and the rows at the partition's ends."""

    def pack(kind, a, b, label=None, n=None):
        k = len(a)
        none = pa.nulls(k)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * k, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(label, pa.binary()) if label is not None else none.cast(pa.binary()), pa.array(n, pa.int64()) if n is not None else none.cast(pa.int64())],
            schema=OUT,
        )

    def run(batches):
        carry, first, tail = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, WIDTH)
            node, n, c = (batch.column(name).to_numpy() for name in ("node", "n", "c"))
            if borders and first:
                k = min(CROWD, len(node))
                yield pack("border", node[:k], c[:k], label=[r.tobytes() for r in x[:k]], n=n[:k])
            old = 0
            if carry is not None:
                old = len(carry[1])
                x, node, n, c = (np.concatenate(both) for both in zip(carry[:4], (x, node, n, c), strict=True))
            crowded = np.zeros(len(node), bool)
            if len(node) > CROWD:
                crowded[CROWD:] = (x[CROWD:, :PREFIX] == x[:-CROWD, :PREFIX]).all(axis=1)
            for s in range(1, CROWD + 1):
                at = np.arange(max(s, old), len(node))
                if not len(at):
                    continue
                ok = (x[at, :PREFIX] == x[at - s, :PREFIX]).all(axis=1) & _size_ok(n[at], n[at - s]) & (c[at] != c[at - s]) & ~crowded[at]
                at = at[ok]
                if len(at):
                    yield pack("pair", np.minimum(node[at], node[at - s]), np.maximum(node[at], node[at - s]))
            # The first rows of a crowded region show it only by a later row, so a row is told once CROWD more are known.
            thick = crowded.copy()
            hit = np.flatnonzero(crowded)
            for s in range(1, CROWD + 1):
                thick[hit - s] = True
            told = carry[4] if carry is not None else np.zeros(0, bool)
            thick[: len(told)] &= ~told
            fresh = np.flatnonzero(thick)
            if len(fresh):
                yield pack("crowd", node[fresh], c[fresh], label=[r.tobytes() for r in x[fresh]], n=n[fresh])
            thick[: len(told)] |= told
            keep = slice(max(0, len(node) - CROWD), None)
            carry = (x[keep], node[keep], n[keep], c[keep], thick[keep])
            first = False
        if borders and carry is not None:
            k = slice(max(0, len(carry[1]) - CROWD), None)
            yield pack("border", carry[1][k], carry[3][k], label=[r.tobytes() for r in carry[0][k]], n=carry[2][k])

    return run


def _confirm(batches):
    known = WordHashes()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sets: dict[str, np.ndarray] = {}

    def set_of(text: str) -> np.ndarray:
        if text not in sets:
            if len(sets) > 256:
                sets.clear()
            sets[text] = np.unique(shingles(word_hashes(text, known)))
        return sets[text]

    for batch in batches:
        ok = []
        for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            p, q = set_of(x), set_of(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(both > 0 and 100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(ok, pa.bool_()))
    known.clear()
    sets.clear()
    give_back()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked on their full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirm, "a long, b long").distinct()


def _hubs(crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """(region, hub): the most central row of each crowded region."""
    runs = crowd.groupBy("region", "label").agg(F.count("*").alias("c"))
    top = runs.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("label"))
    central = scratch.table(crowd.join(broadcast_if_small(top, SMALL), ["region", "label"]).select("region", "node"), "central")
    score = central.groupBy("node").agg(F.count("*").alias("score"))
    rank = F.struct((-F.col("score")).alias("s"), "node")
    return central.join(broadcast_if_small(score, SMALL), "node").groupBy("region").agg(F.min(rank).alias("r")).select("region", F.col("r.node").alias("hub"))


def _hub_pairs(crowd: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b): crowded rows with the most central row of their region."""
    pairs = crowd.select("region", "node").join(broadcast_if_small(hubs, SMALL), "region").where("node != hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _open_rows(crowd: DataFrame, hubs: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, c, hub, c_hub): the rows of crowded regions that are not one component, with the central row of each."""
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    told = hubs.join(of("hub"), "hub", "left").select("region", "hub", F.coalesce("c_hub", "hub").alias("c_hub"))
    rows = crowd.select("region", "node").join(of("node"), "node", "left").select("region", "node", F.coalesce("c_node", "node").alias("c")).join(broadcast_if_small(told, SMALL), "region")
    rows = scratch.table(rows, "rows")
    regions = scratch.table(rows.where("c != c_hub").select("region").distinct(), "regions")
    open_rows = rows.join(broadcast_if_small(regions, SMALL), "region", "left_semi").where("node != hub")
    return scratch.table(open_rows.select("node", "c", "hub", "c_hub").distinct(), "open")


def _rest_pairs(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of open rows of one central row that may be linked, but those that the central row links anyway."""
    central = texts.withColumnsRenamed({"node": "hub", "text": "hub_text"}).join(broadcast_if_small(rows.select("hub").distinct(), SMALL), "hub", "left_semi")
    central = scratch.table(central, "central-texts")
    joined = rows.join(texts, "node").join(broadcast_if_small(central, SMALL // 8), "hub").select("node", "c", "hub", "c_hub", "text", "hub_text")
    found = scratch.table(joined.mapInArrow(_differences, VALUES_SQL), "differences")
    with_hub = found.where("key IS NULL").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    # Values of one row only are in no other difference. The others of a row are put in order, those of few rows first.
    shared = found.where("key IS NOT NULL").withColumn("rows", F.count("*").over(Window.partitionBy("key"))).where("rows > 1")
    own = Window.partitionBy("node", "hub")
    rest = F.count("*").over(own) - F.row_number().over(own.orderBy("rows", "key")) + 1
    first = shared.withColumn("rest", rest.cast("long")).where("rest >= least").select("key", "node", "c", "n", "d", "rest", "far")
    values = first.repartition("key").sortWithinPartitions("key", F.desc("far"), "node")
    return with_hub.union(values.mapInArrow(_sharing, "a long, b long")).distinct()


def _sorted_pairs(labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of the regions that are not crowded; (label, node, n): rows of crowded ones. Both over partition borders too."""
    out = "kind string, a long, b long, label binary, n long"
    ordered = labels.select("label", "node", "n", "c").repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    found = scratch.table(ordered.mapInArrow(_neighbours(True), out), "found")
    border = found.where("kind = 'border'").select("label", F.col("a").alias("node"), "n", F.col("b").alias("c")).distinct().coalesce(1).sortWithinPartitions("label", "node")
    across = scratch.table(border.mapInArrow(_neighbours(False), out), "across")
    both = found.union(across)
    crowd = both.where("kind = 'crowd'").select("label", F.col("a").alias("node"), "n").distinct()
    return both.where("kind = 'pair'").select("a", "b").where("a != b").distinct(), crowd


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(docs.mapInArrow(_sign, "doc_id long, n long, digest binary, sig binary"), "signed")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.min_by("sig", "doc_id").alias("sig")), "classes")

    labels = classes.select("node", "n", "sig").mapInArrow(_labels, LABELS_SQL).withColumn("c", F.col("node"))
    near, crowded = _sorted_pairs(labels, scratch)
    near = near.withColumn("place", F.lit(1))
    crowd = scratch.table(crowded.select(F.substring("label", 1, PREFIX).alias("region"), "label", "node"), "crowd")
    hubs = scratch.table(_hubs(crowd, scratch), "hubs")
    pairs = scratch.table(near.union(_hub_pairs(crowd, hubs).withColumn("place", F.lit(0))).groupBy("a", "b").agg(F.min("place").alias("place")), "pairs")
    scratch.drop("found", "across", "central")

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = scratch.table(nodes, "nodes")
    texts = scratch.table(docs.withColumnRenamed("doc_id", "node").join(broadcast_if_small(nodes, SMALL), "node", "left_semi"), "texts")

    links, comp, left = None, None, pairs
    for turn in range(3):
        if turn == 1:
            more = scratch.table(_rest_pairs(_open_rows(crowd, hubs, comp, scratch), texts, scratch), "more")
            scratch.drop("rows", "regions", "open", "central-texts", "differences")
            left = left.union(more.join(broadcast_if_small(picked, SMALL), ["a", "b"], "left_anti").withColumn("place", F.lit(2))).groupBy("a", "b").agg(F.min("place").alias("place"))
        if turn:
            own = F.broadcast(comp) if is_small(comp, SMALL) else comp
            of = lambda end: own.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))  # noqa: B023, E731
            left = left.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", "place", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")
            left = scratch.table(left, f"left-{turn}")
        else:
            left = left.select("a", "b", "place", F.col("a").alias("ca"), F.col("b").alias("cb"))
        if turn < 2:
            ends = left.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "a", "b", "place").union(left.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "a", "b", "place"))
            picked = ends.groupBy("c").agg(F.min(F.struct("place" if turn == 0 else "o", "o", "a", "b")).alias("p")).select("p.a", "p.b")
            picked = picked.distinct()
        else:
            picked = left.select("a", "b")
        picked = scratch.table(picked, f"picked-{turn}")
        left = left.join(broadcast_if_small(picked, SMALL), ["a", "b"], "left_anti").select("a", "b", "place") if turn < 2 else None
        new = scratch.table(confirm(picked, texts), f"links-{turn}")
        links = new if links is None else links.union(new)
        comp = scratch.table(components(links, scratch, f"cc{turn}"), f"comp-{turn}")

    moved = classes.join(comp, "node", "left").where("last > node OR component IS NOT NULL").select("digest", F.coalesce("component", "node").alias("component"))
    moved = scratch.table(moved, "moved")
    out = signed.select("doc_id", "n", "digest").join(broadcast_if_small(moved, SMALL), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
    scratch.drop("nodes", "texts", "pairs", "classes", "crowd", "hubs", "more")
    return out
