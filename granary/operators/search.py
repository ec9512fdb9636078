"""Lexical and vector search over chunk tables.

The index is two tables: postings (token, id, tf, positions, dl), to be stored bucketed or sorted by token so that a
query reads its tokens only, and one row of statistics. Query frames are small and bounded by the request, so they
are broadcast; everything that grows with the corpus is aggregated map-side or joined by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.textnorm import tokens

K1, B = 1.2, 0.75
COUNT_CAP = 1000


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf, positions, dl): positions are 0-based."""
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    placed = words.select("id", F.size("words").alias("dl"), F.posexplode("words").alias("position", "token"))
    return placed.groupBy("id", "token", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def statistics(chunks: DataFrame, text_col: str) -> DataFrame:
    """One row (n, avgdl) over all chunks with tokens; filters never change it."""
    size = F.size(tokens(F.col(text_col)))
    return chunks.agg(F.count_if(size > 0).alias("n"), (F.sum(size) / F.count_if(size > 0)).alias("avgdl"))


def query_terms(chunks: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """Adds dl and tfs, one count per term, without an index: one pass over the texts."""
    words = tokens(F.col(text_col))
    counted = F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.size(F.filter(F.col("__words"), lambda w: w == t)))
    return chunks.withColumn("__words", words).withColumn("dl", F.size("__words")).withColumn("tfs", counted).drop("__words")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def match_all(chunks: DataFrame, text_col: str, query: str) -> DataFrame:
    """Chunks that have every token of the query."""
    wanted = tokens(F.lit(query))
    return chunks.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(F.col(text_col)))) == 0))


def match_phrase(chunks: DataFrame, text_col: str, phrase: str) -> DataFrame:
    """Chunks that have the tokens of the phrase one after another."""
    pad = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    wanted = tokens(F.lit(phrase))
    return chunks.where((F.size(wanted) > 0) & F.contains(pad(tokens(F.col(text_col))), pad(wanted)))


def phrase_by_positions(index: DataFrame, terms: list[str]) -> DataFrame:
    """(id, hits) from the postings: starts at which all terms follow each other. Repeated terms are allowed."""
    wanted = index.sparkSession.createDataFrame(list(enumerate(terms)), "step int, token string")
    starts = index.join(F.broadcast(wanted), "token").select("id", "step", F.explode("positions").alias("p")).select("id", (F.col("p") - F.col("step")).alias("start"), "step")
    return starts.groupBy("id", "start").agg(F.count("*").alias("c")).where(F.col("c") == len(terms)).groupBy("id").agg(F.count("*").alias("hits"))


def exclude(chunks: DataFrame, text_col: str, entries: list[str]) -> DataFrame:
    """Without chunks that have any token of an entry."""
    found = F.array_distinct(F.flatten(F.array(*[tokens(F.lit(e)) for e in entries]))) if entries else None
    return chunks if found is None else chunks.where(~F.arrays_overlap(tokens(F.col(text_col)), found))


def in_categories(chunks: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """One of a key's values, for each key that has values; array columns match by any element; unknown keys match nothing."""
    types = dict(chunks.dtypes)
    for key, allowed in wanted.items():
        if not allowed:
            continue
        if key not in types:
            chunks = chunks.where(F.lit(False))
        elif types[key].startswith("array"):
            chunks = chunks.where(F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in allowed])))
        else:
            chunks = chunks.where(F.col(key).isin(allowed))
    return chunks


def in_years(chunks: DataFrame, start: int | None, end: int | None, date: str = "date", series: tuple[str, str] = ("series_start_date", "series_end_date")) -> DataFrame:
    """Dated chunks by their date, undated ones by the overlap of their series; a missing bound is open."""
    if start is None and end is None:
        return chunks
    d, s, e = F.col(date), F.col(series[0]), F.col(series[1])
    own, overlap = d.isNotNull(), d.isNull()
    if start is not None:
        first = F.make_date(F.lit(start), F.lit(1), F.lit(1))
        own, overlap = own & (F.to_date(d) >= first), overlap & (F.to_date(e) >= first)
    if end is not None:
        last = F.make_date(F.lit(end), F.lit(12), F.lit(31))
        own, overlap = own & (F.to_date(d) <= last), overlap & (F.to_date(s) <= last)
    return chunks.where(own | overlap)


def in_language(chunks: DataFrame, language: str | None, column: str = "language") -> DataFrame:
    code = {"hindi": "hi", "gujarati": "gu"}.get(language or "all", language)
    return chunks if code in (None, "all") else chunks.where(F.col(column) == code)


def score(chunks: DataFrame, id_col: str, text_col: str, terms: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """candidates (default: all chunks) that have every term, with their BM25 score over the statistics of all chunks."""
    told = query_terms(chunks, text_col, terms)
    dfs = [F.count_if(F.col("tfs")[k] > 0).alias(f"df{k}") for k in range(len(terms))]
    stats = told.agg(F.count_if(F.col("dl") > 0).alias("n"), (F.sum("dl") / F.count_if(F.col("dl") > 0)).alias("avgdl"), *dfs)
    rows = query_terms(candidates if candidates is not None else chunks, text_col, terms)
    rows = rows.where(F.forall("tfs", lambda t: t > 0)).join(F.broadcast(stats), F.lit(True))  # one row of statistics
    total = sum((bm25(F.col("tfs")[k], F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col(f"df{k}"))) for k in range(len(terms))), F.lit(0.0))
    return rows.select(*(candidates or chunks).columns, total.alias("score"))


def page(hits: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    return hits.orderBy(*order).offset((number - 1) * size).limit(size)


def totals(hits: DataFrame) -> DataFrame:
    """One row: the count as far as the cap, and the exact one."""
    return hits.agg(F.count("*").alias("total_exact")).select(F.least(F.col("total_exact"), F.lit(COUNT_CAP)).alias("total_hits"), "total_exact")


def highlight(text: Column, terms: list[str]) -> Column:
    """The text with each occurrence of a term between <em> and </em>, or empty without one."""
    if not terms:
        return F.lit("")
    escaped = "|".join("\\Q" + t + "\\E" for t in sorted(terms, key=len, reverse=True))
    pattern = r"(?iu)(?<![\p{L}\p{M}\p{N}])(" + escaped + r")(?![\p{L}\p{M}\p{N}])"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "<em>$1</em>")).otherwise(F.lit(""))


def snippet(text: Column, terms: list[str] | None) -> Column:
    """What a result shows: marked terms for a lexical hit, empty without one; the whole text for a vector hit (no terms)."""
    return text if terms is None else highlight(text, terms)


def cosine(a: Column, b: Column) -> Column:
    """Null if either side has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def nearest(rows: DataFrame, vector_col: str, query: list[float] | None, k: int, id_col: str) -> DataFrame:
    """The k rows nearest to a query vector, by (1 + cosine) / 2; an absent query finds nothing. Filter rows beforehand."""
    if query is None:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    own = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector_col).isNotNull()).withColumn("score", (1 + cosine(F.col(vector_col), own)) / 2)
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(k)


def similar(rows: DataFrame, id_col: str, vector_col: str, item, k: int = 10) -> DataFrame:
    """The k nearest to one of the rows, without itself."""
    own = rows.where(F.col(id_col) == item).select(F.col(vector_col).alias("__own")).limit(1)
    others = rows.where(F.col(id_col) != item).join(F.broadcast(own), F.lit(True))  # one row
    scored = others.withColumn("score", (1 + cosine(F.col(vector_col), F.col("__own"))) / 2).drop("__own")
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(k)


def best_per_key(side: DataFrame, keys: list[str], value: str = "score", name: str = "score") -> DataFrame:
    return side.groupBy(*keys).agg(F.max(value).alias(name))


def max_normalised(rows: DataFrame, value: str) -> DataFrame:
    """value over the greatest one of all rows; 0 where that is not above 0."""
    top = rows.agg(F.max(value).alias("__top"))
    share = F.when(F.col("__top") > 0, F.col(value) / F.col("__top")).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(top), F.lit(True)).withColumn(value, share).drop("__top")  # one row


def weighted(lexical: Column, vector: Column, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    return weights[0] * lexical + weights[1] * vector


def fuse(lexical: DataFrame, vector: DataFrame, keys: list[str], weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Both sides' best score per key over the side's best score, weighted and added; keys of one side count with 0 on the other."""
    sides = [max_normalised(best_per_key(side, keys, "score", name), name) for name, side in (("lexical", lexical), ("vector", vector))]
    both = sides[0].join(sides[1], keys, "full_outer").na.fill(0.0, ["lexical", "vector"])
    return both.withColumn("score", weighted(F.col("lexical"), F.col("vector"), weights))


def fuse_ranks(lexical: DataFrame, vector: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two result pages: rows have a 0-based rank."""
    both = lexical.select(key, "rank").unionByName(vector.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def rerank(hits: DataFrame, scores: DataFrame, key: str, size: int, number: int) -> DataFrame:
    """Hits by their rerank score, those without one last, one page of them; `score` becomes the rerank score where there is one."""
    joined = hits.join(F.broadcast(scores), key, "left")
    return page(joined.withColumn("score", F.coalesce("rerank_score", "score", F.lit(0.0))), size, number, F.desc_nulls_last("rerank_score"), F.col(key))


@dataclass(frozen=True)
class SearchRequest:
    """What a caller asks for. content types: a name with (enabled, page size, page number)."""

    query: str
    language: str = "hi"
    exact_match: bool = False
    exclude_words: tuple[str, ...] = ()
    categories: dict[str, list[str]] = field(default_factory=dict)
    start_year: int | None = None
    end_year: int | None = None
    page_size: int = 10
    page_number: int = 1
    content_type: str | None = None

    def lexical_categories(self) -> dict[str, list[str]]:
        """The content type, unless the caller chose a category."""
        extra = {"category": [self.content_type]} if self.content_type and "category" not in self.categories else {}
        return self.categories | extra

    def vector_categories(self) -> dict[str, list[str]]:
        """The content type, whatever category the caller chose."""
        return self.categories | ({"category": [self.content_type]} if self.content_type else {})
