"""SentencePiece encoding and decoding as relations over a lattice.

Encoding works on the distinct words of the corpus (see granary.llm.blocks). Texts are cut only between
characters that stand side by side in no piece, where no piece can lie across, so words may be encoded
alone. For each distinct word the substrings up to the longest piece are exploded and equi-joined to the
piece table; the matches are the edges of the word's lattice and are grouped by word. A higher-order
aggregate folds the lattice:

- unigram models: Viterbi over the word's positions;
- BPE models: their encoding is not the best path of any additive score, so Viterbi would give other ids
  than the library. The fold merges the best-ranked pair of neighbours whose union is an edge, until none is.

Characters without an edge become byte pieces. Words over LONG characters, which a fold would take squared
time for, are merged with a heap instead. The ids go back to the blocks and are strung together per text.

Null texts count as empty and have no ids; repeated rows are encoded each; other columns are ignored; ids of
documents may repeat or be null. Decoding gives the text back, except that U+2581 comes back as a space.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.blocks import Values, assemble, pack, store, unpack
from granary.llm.common import Scratch, give_back, let

META = "▁"
LONG = 32
BIG = 2**31 - 1


@dataclass(frozen=True)
class Model:
    """A piece table: (piece, id, rank or score) of the normal pieces, ids of the bytes, the unknown id."""

    kind: str
    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown: int
    size: int

    @property
    def longest(self) -> int:
        return max(len(p) for p, *_ in self.pieces)


#: The kinds of model by their number in the file.
KINDS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def kind_of(data: bytes) -> str:
    """The kind that a .model file tells: field 3 of its second field, the trainer's settings; unigram if it tells none."""

    def fields(part: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                out |= (part[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if part[at - 1] < 128:
                    return out

        while at < len(part):
            key = number()
            wire = key & 7
            if wire == 0:
                yield key >> 3, number()
                continue
            size = number() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, part[at : at + size]
            at += size

    found = 1
    for name, value in fields(data):
        if name == 2:
            found = dict(fields(value)).get(3, 1)
    return KINDS[found]


@cache
def load(path: str) -> Model:
    """The table of a .model file; only BPE with an identity normalizer and a dummy prefix, as the library reports by example. Others are refused."""
    import sentencepiece

    with open(path, "rb") as file:
        kind = kind_of(file.read())
    if kind != "bpe":
        raise ValueError(f"only BPE models are supported, this one is of the kind {kind}")

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for probe in ("a  b  ", "  a", "ﬁ Å", "Ａ\tb\r\n"):
        if sp.decode(sp.encode(probe)) != probe or sp.encode(probe, out_type=str)[0][:1] != META:
            raise ValueError("only models with a dummy prefix and without other normalization are supported")
    n = sp.get_piece_size()
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not special(i)]
    order = {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Model(kind, tuple((p, i, order[i]) for p, i, _ in rows), tuple(byte_ids) if sp.is_byte(byte_ids[0]) else (), sp.unk_id(), n)


@cache
def neighbours(model: Model) -> frozenset[str]:
    """Pairs of characters that stand side by side in a piece."""
    return frozenset(p[k : k + 2] for p, *_ in model.pieces for k in range(len(p) - 1))


def splitter(model: Model):
    """Text to words, whose concatenation is the normalized text: cut where no piece can lie across."""
    pairs = neighbours(model)
    chars = sorted({c for p in pairs for c in p})
    kind = np.zeros(0x110000, np.uint16)
    kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for p in pairs:
        joined[kind[ord(p[0])], kind[ord(p[1])]] = True

    def split(text: str) -> list[str]:
        if not text:
            return []
        text = META + text.replace(" ", META)
        kinds = kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = (np.flatnonzero(~joined[kinds[:-1], kinds[1:]]) + 1).tolist()
        ends.append(len(text))
        return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    return split


def _splitter_of(path: str):
    made = {}

    def split(text: str) -> list[str]:
        if path not in made:
            made[path] = splitter(load(path))
        return made[path](text)

    return split


def merge(word: str, ranks: dict[str, tuple[int, int]]) -> list[str]:
    """The BPE symbols of a word with a heap: n log n."""
    left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    part: list[str | None] = list(word)
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < len(word) and (found := ranks.get(both := part[i] + part[right[i]])):
            heapq.heappush(heap, (found[0], i, both))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if part[i] is None or (j := right[i]) >= len(word) or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        right[i] = right[j]
        if right[i] < len(word):
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [p for p in part if p is not None]


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """words has bucket and word. Adds edges: for each substring that is a piece, start * 64 + length -> rank * 2^25 + id, and an entry for 0."""
    table = words.sparkSession.createDataFrame([(p, (int(r) << 25) | i) for p, i, r in model.pieces] + [("", 0)], "piece string, value long")
    # Start 0 stands for the empty substring, so that words without a piece stay in.
    starts = words.select("bucket", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    tails = starts.select("bucket", "word", "i", F.when(F.col("i") == 0, F.lit("")).otherwise(F.substring("word", F.col("i"), F.lit(model.longest))).alias("tail"))
    spans = tails.select("bucket", "word", "i", "tail", F.explode(F.sequence(F.least(F.lit(1), F.length("tail")), F.length("tail"))).alias("k"))
    spans = spans.select("bucket", "word", (F.col("i") * 64 + F.col("k")).cast("long").alias("at"), F.substring("tail", F.lit(1), F.col("k")).alias("piece"))
    # The piece table is a fixed vocabulary, the same at any size of the corpus.
    edges = spans.join(F.broadcast(table), "piece").groupBy("bucket", "word").agg(F.collect_list(F.shiftleft("at", 50).bitwiseOR(F.col("value"))).alias("e"))
    split = F.map_from_arrays(F.transform("e", lambda x: F.shiftright(x, 50).cast("int")), F.transform("e", lambda x: x.bitwiseAND(F.lit((1 << 50) - 1))))
    return edges.select("bucket", "word", split.alias("edges"))


def _rank(value: Column) -> Column:
    return F.shiftright(value, 25)


def _id(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << 25) - 1)).cast("int")


def bpe_fold(word: Column, edges: Column) -> Column:
    """Starts of the symbols of a word, with its length + 1 at the end.

    The state has these starts and, for each pair of neighbours, the rank of its union. A step merges the leftmost
    pair of the lowest rank and looks up the two pairs that change.
    """
    none = F.lit(BIG).cast("long")
    rank = lambda start, end: F.coalesce(_rank(F.try_element_at(edges, start * 63 + end)), none)
    pair = lambda b, o: F.struct(b.alias("b"), o.alias("o"))
    first = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank(i, i + 2))
    empty = F.array().cast("array<bigint>")
    start = pair(F.sequence(F.lit(1), F.length(word) + 1), F.when(F.length(word) > 1, first).otherwise(empty))

    def merged(s: Column, j: Column) -> Column:
        b, o = s["b"], s["o"]
        before = F.when(j > 0, F.array(rank(F.get(b, j - 1), F.get(b, j + 2)))).otherwise(empty)
        after = F.when(j + 3 < F.size(b), F.array(rank(F.get(b, j), F.get(b, j + 3)))).otherwise(empty)
        return pair(
            F.concat(F.slice(b, F.lit(1), j + 1), F.slice(b, j + 3, F.size(b))),
            F.concat(F.slice(o, F.lit(1), F.greatest(j - 1, F.lit(0))), before, after, F.slice(o, j + 3, F.size(b))),
        )

    def step(s: Column, _: Column) -> Column:
        def with_least(m: Column) -> Column:
            return F.when(m < none, let(F.array_position(s["o"], m).cast("int") - 1, lambda j: merged(s, j))).otherwise(s)

        return let(F.coalesce(F.array_min(s["o"]), none), with_least)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), start, step, lambda s: s["b"])


def viterbi_fold(word: Column, edges: Column, scores: Column, longest: int, unknown: float) -> Column:
    """Starts of the best path's symbols, with its length + 1 at the end.

    scores: by id, added up along a path; unknown is what a character without an edge costs. Ties go to the longer last symbol.
    """
    n = F.length(word)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best: Column, end: Column) -> Column:
        def arc(k: Column) -> Column:
            start = end - k + 1
            found = F.try_element_at(edges, start * 64 + k)
            score = F.coalesce(F.get(scores, _id(found)), F.when(k == 1, F.lit(unknown)))
            return F.struct((F.get(best, start - 1)["score"] + score).alias("score"), (-start).alias("back"))

        arcs = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), end)), arc), lambda a: a["score"].isNotNull())
        return let(F.array_max(arcs), lambda a: F.concat(best, F.array(F.struct(a["score"].alias("score"), (-a["back"]).alias("back")))))

    def walk(table: Column) -> Column:
        back = lambda s, _: F.when(s[0] > 1, F.concat(F.array(F.get(table, s[0] - 1)["back"]), s)).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), back)

    return let(F.aggregate(F.sequence(F.lit(1), n), first, step), walk)


def symbols_to_ids(word: Column, starts: Column, edges: Column, model: Model) -> Column:
    """Ids of the symbols; the bytes of characters that are no piece, or the unknown id."""
    byte_ids = F.array(*[F.lit(b) for b in model.byte_ids]) if model.byte_ids else None

    def ids_of(start: Column, end: Column) -> Column:
        found = _id(F.try_element_at(edges, start * 63 + end))
        if byte_ids is None:
            return F.array(F.coalesce(found, F.lit(model.unknown)))
        hexed = F.hex(F.encode(F.substring(word, start, F.lit(1)), "UTF-8"))
        codes = F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda k: F.get(byte_ids, F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(found.isNotNull(), F.array(found)).otherwise(codes)

    return F.flatten(F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda s, k: ids_of(s, F.get(starts, k + 1))))


def _packed(ids: Column, width: int) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 2 * width, "0")), ""))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """words has bucket and word, distinct and at most LONG characters each. (bucket, word, value): the ids as big-endian numbers of width(model) bytes."""
    folded = lattice(words, model)
    starts = bpe_fold(F.col("word"), F.col("edges"))
    ids = let(starts, lambda s: symbols_to_ids(F.col("word"), s, F.col("edges"), model))
    return folded.select("bucket", "word", _packed(ids, width(model)).alias("value"))


def encode_long(word: str, model: Model, ranks: dict[str, tuple[int, int]]) -> bytes:
    ids = []
    for s in merge(word, ranks):
        found = ranks.get(s)
        ids += [found[1]] if found else [model.byte_ids[b] for b in s.encode()] if model.byte_ids else [model.unknown]
    return np.array(ids, f">u{width(model)}").tobytes()


def _answer(path: str):
    """Per bucket: the ids of each block's words, packed as their numbers of ids and the ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = load(path)
        w, known = width(model), right["word"].combine_chunks()
        lists = left["words"].combine_chunks()
        words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = pc.index_in(words, value_set=known)
        answers = right["value"].to_pylist()
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            # Words too long for a fold.
            long = pc.unique(words.filter(at.is_null()))
            ranks = {p: (int(r), i) for p, i, r in model.pieces}
            place[place < 0] = len(answers) + pc.index_in(words.filter(at.is_null()), value_set=long).to_numpy(zero_copy_only=False)
            answers += [encode_long(x, model, ranks) for x in long.to_pylist()]
        sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // w
        value = Values(sizes, np.frombuffer(b"".join(answers), f">u{w}"))
        bodies = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            part = place[a:b]
            bodies.append([*pack(sizes[part]), zstandard.compress(value.of(part).tobytes())])
        give_back()
        return pa.Table.from_arrays([left["bucket"], left["block"], pa.array(bodies, pa.list_(pa.binary()))], names=["bucket", "block", "body"])

    return run


def _values(w: int):
    def run(body: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return unpack(body[:2]), np.frombuffer(zstandard.decompress(body[2]), f">u{w}").astype(np.int32)

    return run


def width(model: Model) -> int:
    return 2 if model.size <= 65536 else 4


@cache
def _piece_bytes(path: str) -> np.ndarray:
    model = load(path)
    out = np.full(model.size, b"", object)
    out[model.unknown] = " ⁇ ".encode()
    for p, i, _ in model.pieces:
        out[i] = p.replace(META, " ").encode()
    for b, i in enumerate(model.byte_ids):
        out[i] = bytes([b])
    return out


def decode(ids: np.ndarray, path: str) -> str:
    """The text of a sequence of ids, without the dummy prefix."""
    text = b"".join(_piece_bytes(path)[ids]).decode(errors="replace")
    return text[1:] if text[:1] == " " else text


def decode_column(path: str):
    """A vectorised function from array<int> to the text."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode(np.asarray(x, np.int64), path))

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids; or with digests: doc_id, n_tokens, ids_sha256 (of the ids as 32-bit little-endian), round_trip (the decoded ids give the text)."""
    model, scratch = load(path), Scratch(spark)
    split, w = _splitter_of(path), width(model)
    blocks, words = store(scratch, docs, id_col, text_col, split, counted=False, mark=mark_of if digests else None)
    # Dealt by bucket once: the distinct words and the way back to the blocks both read that. The block goes along with
    # each word so that both ask for the same columns and Spark reuses the exchange.
    each_word = F.explode(F.transform("words", lambda w: F.struct(w.alias("word"), F.col("block"))))
    distinct = words.select(F.col("bucket").alias("bucket"), each_word.alias("w")).select("bucket", "w.word").where(F.length("word") <= LONG).groupBy("bucket", "word").agg(F.lit(1).alias("one"))
    encoded = encode_words(distinct.select("bucket", "word"), model)
    values = words.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInArrow(_answer(path), "bucket long, block long, body array<binary>")
    shape = "doc_id long, n_tokens long, " + ("ids_sha256 string, round_trip boolean" if digests else "ids array<int>")

    def each(doc_ids, n_bytes, marks, parts, value):
        ids = [value.of(part) for part in parts]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        columns = {"doc_id": doc_ids, "n_tokens": pa.array(counts)}
        if digests:
            columns["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string())
            columns["round_trip"] = pa.array([mark_of(decode(x, path)) == m for x, m in zip(ids, marks.to_pylist(), strict=True)], pa.bool_())
        else:
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_pydict(columns)

    return assemble(blocks, values, _values(w), each, shape)


def mark_of(text: str) -> bytes:
    return hashlib.blake2b(text.replace(META, " ").encode(), digest_size=8).digest()
