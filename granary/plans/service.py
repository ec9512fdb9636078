"""The search service's calls as plans over its tables.

chunks: chunk_id, document_id, para_ord, category, language, text, vector_embedding, date, series dates, metadata
columns; books: original_filename, verses, prose_sections; facet rows: content_type, key, language, values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import is_lexical_query
from granary.operators import books as B
from granary.operators import facets as FC
from granary.operators import index as IX
from granary.operators import neighbours, search, suggest
from granary.operators.index import Index
from granary.operators.search import SearchRequest

RESULT = ["chunk_id", "document_id", "score", "snippet"]


def is_lexical(chunks: DataFrame, request: SearchRequest) -> bool:
    """Which side answers; told from the request alone."""
    probe = chunks.sparkSession.createDataFrame([(request.query, request.exact_match, list(request.exclude_words))], "q string, e boolean, x array<string>")
    return probe.select(is_lexical_query(F.col("q"), F.col("e"), F.col("x"))).first()[0]


def _filtered(chunks: DataFrame, request: SearchRequest, categories: dict[str, list[str]]) -> DataFrame:
    return search.in_years(search.in_categories(chunks, categories), request.start_year, request.end_year)


def lexical(chunks: DataFrame, request: SearchRequest) -> tuple[DataFrame, DataFrame]:
    """(page of results, totals). Scores use the statistics of all chunks of the language."""
    chunks = search.in_language(chunks, request.language)
    terms = [t for t in request.query.lower().split() if t]
    found = search.exclude(_filtered(chunks, request, request.lexical_categories()), "text", list(request.exclude_words))
    if request.exact_match:
        found = search.match_phrase(found, "text", request.query)
    hits = search.score(chunks, "chunk_id", "text", terms, found)
    rows = search.page(hits, request.page_size, request.page_number, F.desc("score"), F.col("chunk_id"))
    return rows.select("chunk_id", "document_id", "score", search.snippet(F.col("text"), terms).alias("snippet")), search.totals(hits)


def lexical_by_index(chunks: DataFrame, index: Index, request: SearchRequest) -> tuple[DataFrame, DataFrame]:
    """lexical() from the stored index of the chunks of the request's language: only a page of texts is read."""
    terms = [t for t in request.query.lower().split() if t]
    hits = IX.without(IX.score(index, terms), index, sorted({w for e in request.exclude_words for w in e.lower().split()}))
    if request.exact_match:
        hits = hits.join(IX.phrase(index, terms).select("id"), "id", "left_semi")
    chunks = search.in_language(chunks, request.language)
    found = _filtered(chunks, request, request.lexical_categories()).select(F.col("chunk_id").alias("id"), "document_id")
    hits = hits.join(found, "id").withColumnRenamed("id", "chunk_id")
    rows = search.page(hits, request.page_size, request.page_number, F.desc("score"), F.col("chunk_id"))
    shown = chunks.select("chunk_id", "text").join(F.broadcast(rows), "chunk_id")  # one page
    return shown.select("chunk_id", "document_id", "score", search.snippet(F.col("text"), terms).alias("snippet")).orderBy(F.desc("score"), "chunk_id"), search.totals(hits)


def vector(chunks: DataFrame, request: SearchRequest, query_vector: list[float] | None, rerank=None, top: int | None = None) -> DataFrame:
    """A page of the nearest chunks. top: how many to retrieve before reranking, by default one page, so that later pages are empty; page_size * page_number gives them too."""
    found = search.in_language(_filtered(chunks, request, request.vector_categories()), request.language)
    k = top or request.page_size
    hits = search.nearest(found, "vector_embedding", query_vector, k, "chunk_id")
    if rerank is not None:
        hits = hits.withColumn("score", rerank(F.col("text")))
    rows = search.page(hits, request.page_size, request.page_number, F.desc_nulls_last("score"), F.col("chunk_id"))
    return rows.select("chunk_id", "document_id", "score", search.snippet(F.col("text"), None).alias("snippet"))


def similar(chunks: DataFrame, chunk_id: str, size: int = 10) -> DataFrame:
    return search.similar(chunks, "chunk_id", "vector_embedding", chunk_id, size).select("chunk_id", "document_id", "score", F.col("text").alias("snippet"))


def context(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk with the one before and the one after; nothing for chunks without a place."""
    own = chunks.where(F.col("chunk_id") == chunk_id).select("document_id").distinct()
    near = chunks.where(F.col("para_ord").isNotNull()).join(F.broadcast(own), "document_id", "left_semi")  # one document
    return neighbours.context(near, "document_id", ["para_ord"], ["chunk_id", "text"]).where(F.col("chunk_id") == chunk_id)


def verse(books: DataFrame, filename: str, seq: int) -> DataFrame:
    one = books.where(F.col("original_filename") == filename).limit(1)
    return one.select(B.verse_by_number(F.col("verses"), F.lit(seq)).alias("v")).where("v IS NOT NULL").select("v.*")


def prose(books: DataFrame, filename: str, seq: int) -> DataFrame:
    one = books.where(F.col("original_filename") == filename).limit(1)
    return one.select(B.prose_by_number(F.col("prose_sections"), F.lit(seq)).alias("p")).where("p IS NOT NULL").select("p.*")


def metadata(facet_rows: DataFrame, allowed: list[str]) -> DataFrame:
    return FC.pivot_facets(facet_rows.where(F.col("key").isin(allowed)))


def suggestions(chunks: DataFrame, vocabulary: DataFrame, query: str, n: int = 3, min_score: float = 0.6) -> list[str]:
    """Other spellings of a query, for when nothing was found. vocabulary: token, df."""
    words = query.lower().split()
    if not words:
        return []
    rows = chunks.sparkSession.createDataFrame([(w,) for w in words], "word string")
    found = suggest.similar_words(rows, vocabulary, n=n, min_score=min_score).collect()  # n options per word of one query
    options = [[r.option for r in sorted(found, key=lambda r: r.rank) if r.word == w] for w in words]
    one = chunks.sparkSession.createDataFrame([(words, options)], "w array<string>, o array<array<string>>")
    return one.select(suggest.recombine(F.col("w"), F.col("o"), n)).first()[0]
