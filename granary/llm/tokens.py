"""Token counts of a byte-level BPE tokenizer, without making the ids.

A text's token count is the sum over its distinct pre-tokens of frequency x pieces. Pieces are counted once
per distinct pre-token of the corpus: the blocks' dictionaries meet by word, each task encodes a word the
first time it sees it and answers for every block that has it. The counts go back to the blocks and are
multiplied with the per-document frequencies.

Null texts count as empty, with no tokens; repeated rows are counted each; other columns are ignored; ids
may repeat or be null. A special token written out in a text is one token, as the library has it by default.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.blocks import assemble, pack, store, unpack
from granary.llm.common import Scratch

#: Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@cache
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def splitter(path: str):
    """Text to pre-tokens; special tokens are pre-tokens of their own and end what stands before them."""
    import json

    import regex

    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    pre = config["pre_tokenizer"]
    if config["model"]["type"] != "BPE" or config["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("only byte-level BPE without a normalizer or added spaces is supported")
    added = config["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take in their neighbourhood are not supported")
    find = regex.compile(PRE_TOKEN).findall
    special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
    strings = [t["content"] for t in added]

    # The libraries' tables of letters and digits are of different years. Characters beyond the Latin blocks are tried
    # once; a text with one that the pattern takes for another kind goes to the tokenizer's own splitter.
    rare, agree = regex.compile("[\u0250-\U0010ffff]").findall, {}
    own = load(path).pre_tokenizer.pre_tokenize_str

    def by_library(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in own(text)]

    def same(c: str) -> bool:
        if c not in agree:
            probe = f"a{c}1 {c}{c}!{c}"
            agree[c] = find(probe) == by_library(probe)
        return agree[c]

    def plain(text: str) -> list[str]:
        found = rare(text)
        return find(text) if not found or all(map(same, set(found))) else by_library(text)

    def split(text: str) -> list[str]:
        if special is None or not any(s in text for s in strings):
            return plain(text)
        return [w for k, part in enumerate(special.split(text)) for w in ([part] if k % 2 else plain(part))]

    return split


def _count_pieces(path: str):
    def run(batches):
        tokenizer, known = load(path), {}
        for batch in batches:
            rows = batch.column("words").to_pylist()
            new = list({w for ws in rows for w in ws if w not in known})
            for k in range(0, len(new), 5000):
                part = new[k : k + 5000]
                known.update(zip(part, (len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            yield pa.RecordBatch.from_pydict(
                {"bucket": batch.column("bucket"), "block": batch.column("block"), "body": [pack(np.array([known[w] for w in ws], np.int64)) for ws in rows]},
                schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.list_(pa.binary()))]),
            )

    return run


def _counts(body: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts = unpack(body)
    return np.ones(len(counts), np.int64), counts


def token_counts(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    blocks, words = store(Scratch(spark), docs, id_col, text_col, lambda t: splitter(path)(t), counted=True)
    pieces = words.mapInArrow(_count_pieces(path), "bucket long, block long, body array<binary>")

    def each(ids, n_bytes, marks, parts, value):
        def total(p: np.ndarray) -> int:
            at, n = np.split(p, 2)
            return int((value.flat[value.starts[np.cumsum(at)]] * n).sum())

        return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array([total(p) for p in parts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return assemble(blocks, pieces, _counts, each, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
