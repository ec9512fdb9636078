"""Search queries over the documents and embeddings tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions import scalars, textnorm
from granary.operators import index, models, search
from granary.plans.base import Catalog, table, values
from granary.session import shared_dir

C = Catalog()

_built: dict[tuple[str, str], str] = {}


def indexed(spark, sf) -> index.Index:
    """The index of the documents, written at first use by an application and read from then on; files are taken not to change under it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        path = f"{shared_dir(spark)}/granary-index-{uuid.uuid4().hex}"
        index.write(table(spark, sf, "documents"), "doc_id", "text", path)
        _built[key] = path
    return index.read(spark, _built[key])


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
DOCS = f"(SELECT doc_id, lang, source, {TOKENS} AS w FROM documents)"


def bm25_sql(terms: list[str], where: str = "TRUE") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS df{k}" for k, t in enumerate(terms))
    part = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * len(w) / avgdl))" for k in range(len(terms)))
    every = " AND ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""WITH d AS {DOCS},
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::DOUBLE / count(*) FILTER (len(w) > 0) AS avgdl, {df} FROM d),
t AS (SELECT *, {tf} FROM d)
SELECT doc_id, lang, source, {part} AS score FROM t, s WHERE {every} AND {where}"""


TOP = "SELECT doc_id, lang, source, round(score, 6) AS score FROM ({}) ORDER BY score DESC, doc_id LIMIT {}"


@C.query("flagship_search", TOP.format(bm25_sql(["the", "that"], "lang = 'en' AND NOT list_contains(w, 'idiot')"), 10))
def flagship(spark, sf):
    """AND match, exclusion, category filter, BM25 and top 10, without reading a text."""
    own = indexed(spark, sf)
    docs = search.in_categories(table(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": ["en"]})
    hits = index.without(index.score(own, ["the", "that"]), own, ["idiot"]).withColumnRenamed("id", "doc_id").join(docs, "doc_id")
    return search.page(hits, 10, 1, F.desc("score"), F.col("doc_id")).select("doc_id", "lang", "source", F.round("score", 6).alias("score"))


@C.query(
    "search_index_build",
    f"WITH p AS (SELECT doc_id, unnest(w) AS t FROM {DOCS}) SELECT (SELECT count(DISTINCT doc_id) FROM p) AS n, round((SELECT count(*) FROM p)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM p), 6) AS avgdl, (SELECT count(DISTINCT t) FROM p) AS n_terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, t FROM p)) AS n_postings",
)
def build(spark, sf):
    """Writes the index anew and counts what it holds."""
    new = index.write(table(spark, sf, "documents"), "doc_id", "text", f"{shared_dir(spark)}/granary-index-{uuid.uuid4().hex}")
    held = new.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return new.stats.join(F.broadcast(held), F.lit(True)).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")  # one row each


@C.query("f1_match_all", f"SELECT doc_id FROM {DOCS} WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'of')")
def f1(spark, sf):
    return search.match_all(table(spark, sf, "documents"), "text", "The and OF").select("doc_id")


@C.query("f2_match_phrase", f"SELECT doc_id FROM {DOCS} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def f2(spark, sf):
    return search.match_phrase(table(spark, sf, "documents"), "text", "of the").select("doc_id")


@C.query(
    "f2_phrase_by_positions",
    f"WITH p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {DOCS}) SELECT a.doc_id AS id, count(*) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY ALL",
)
def f2b(spark, sf):
    return index.phrase(indexed(spark, sf), ["of", "the"])


@C.query("f3_exclude", f"SELECT doc_id FROM {DOCS} WHERE NOT list_has_any(w, ['the', 'les', 'und'])")
def f3(spark, sf):
    return search.exclude(table(spark, sf, "documents"), "text", ["the les", "und"]).select("doc_id")


@C.query("f4_categories", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src3', 'src5')")
def f4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return search.in_categories(docs, {"lang": ["de", "fr"], "source": ["src1", "src3", "src5"], "empty": []}).select("doc_id")


@C.query("f4_unknown_key", "SELECT doc_id FROM documents WHERE FALSE")
def f4b(spark, sf):
    return search.in_categories(table(spark, sf, "documents").select("doc_id", "lang"), {"Lang": ["de"]}).select("doc_id")


@C.query(
    "f5_date_or_series",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date, min(l_shipdate) AS s, max(l_shipdate) AS e
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey FROM c WHERE (date IS NOT NULL AND CAST(date AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31')
OR (date IS NULL AND CAST(s AS DATE) <= DATE '1995-12-31' AND CAST(e AS DATE) >= DATE '1994-01-01')""",
)
def f5(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("series_start_date"), F.max("l_shipdate").alias("series_end_date"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    chunks = orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return search.in_years(chunks, 1994, 1995).select("o_orderkey")


@C.query("f5_open_bound", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def f5b(spark, sf):
    none = F.lit(None).cast("date")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), none.alias("series_start_date"), none.alias("series_end_date"))
    return search.in_years(rows, 1996, None).select("o_orderkey")


@C.query("f6_language", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def f6(spark, sf):
    docs = table(spark, sf, "documents")
    return search.in_language(search.in_language(docs, "all", "lang"), "fr", "lang").select("doc_id")


@C.query("f7_lexical_category", "SELECT doc_id FROM documents WHERE source = 'src2'")
def f7(spark, sf):
    request = search.SearchRequest("x", categories={"category": ["src2"]}, content_type="src1")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"))
    return search.in_categories(docs, request.lexical_categories()).select("doc_id")


@C.query("f8_vector_category", "SELECT doc_id FROM documents WHERE source = 'src1'")
def f8(spark, sf):
    request = search.SearchRequest("x", categories={"category": ["src2"]}, content_type="src1")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"))
    return search.in_categories(docs, request.vector_categories()).select("doc_id")


@C.query("f9_term", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def f9(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@C.query("f10_neighbour_terms", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber IN (1, 3)")
def f10(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    first = items.agg(F.min("l_orderkey").alias("l_orderkey"))
    return items.where(F.col("l_linenumber").isin(1, 3)).join(F.broadcast(first), "l_orderkey", "left_semi")


@C.query("f11_exists", "SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.toxic = 1")
def f11(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("known"))
    joined = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.where(F.col("toxic").isNull() | (F.col("toxic") == 1)).select("doc_id", F.col("known").isNotNull().alias("labelled"))


@C.query("f12_not_self", "SELECT vec_id FROM embeddings WHERE vec_id <> 3")
def f12(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") != 3).select("vec_id")


@C.query("f13_by_name", "SELECT s_suppkey, s_name FROM supplier WHERE s_name = (SELECT min(s_name) FROM supplier) ORDER BY s_suppkey LIMIT 1")
def f13(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    first = rows.agg(F.min("s_name").alias("s_name"))
    return rows.join(F.broadcast(first), "s_name", "left_semi").orderBy("s_suppkey").limit(1).select("s_suppkey", "s_name")


QUERIES = [("इंदौर का इतिहास",), ("इंदौर का इतिहास?",), ("हंपी के बारे में कुछ बताइए",), ("two words",), ("a b c d",), ("x-ray",), ("",), ("दो।",)]


@C.query(
    "f18_router",
    f"SELECT q, NOT regexp_matches(q, '[!-/:-@\\[-`{{-~।॥]') AND len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) < 4 AS lexical FROM {values(QUERIES, 'q VARCHAR')}",
)
def f18(spark, sf):
    return spark.createDataFrame(QUERIES, "q string").select("q", scalars.is_lexical_query(F.col("q")).alias("lexical"))


ROUTED = [("what is this?", True, []), ("what is this?", False, []), ("what is this?", False, ["no"])]


@C.query("f19_router_override", f"SELECT q, exact, exact OR len(skip) > 0 AS lexical FROM {values(ROUTED, 'q VARCHAR, exact BOOLEAN, skip VARCHAR[]')}".replace("SELECT q, exact, exact OR", "SELECT q, exact, len(skip) AS n_skip, exact OR"))
def f19(spark, sf):
    rows = spark.createDataFrame(ROUTED, "q string, exact boolean, skip array<string>")
    return rows.select("q", "exact", F.size("skip").cast("long").alias("n_skip"), scalars.is_lexical_query(F.col("q"), F.col("exact"), F.col("skip")).alias("lexical"))


@C.query("x17_bm25", "SELECT doc_id, round(score, 6) AS score FROM (" + bm25_sql(["the", "in"]) + ")")
def x17(spark, sf):
    return index.score(indexed(spark, sf), ["the", "in"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@C.query("x17_bm25_by_scan", "SELECT doc_id, round(score, 6) AS score FROM (" + bm25_sql(["the", "in"]) + ")")
def x17c(spark, sf):
    """The same without an index, for tables that have none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return search.score(docs, "doc_id", "text", ["the", "in"]).select("doc_id", F.round("score", 6).alias("score"))


@C.query("x17_index_statistics", f"SELECT count(*) FILTER (len(w) > 0) AS n, round(sum(len(w))::DOUBLE / count(*) FILTER (len(w) > 0), 6) AS avgdl FROM {DOCS}")
def x17b(spark, sf):
    return indexed(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@C.query("a10_document_frequency", f"SELECT t AS token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS t FROM {DOCS}) GROUP BY t")
def a10(spark, sf):
    return indexed(spark, sf).terms.select("token", "df")


@C.query("j10_postings_join", f"SELECT doc_id AS id, count(DISTINCT t) AS n FROM (SELECT doc_id, unnest(w) AS t FROM {DOCS}) WHERE t IN ('the', 'and', 'of', 'is') GROUP BY doc_id HAVING count(DISTINCT t) = 4")
def j10(spark, sf):
    found = index.lookup(indexed(spark, sf).postings, ["the", "and", "of", "is"])
    return found.groupBy("id").agg(F.count("*").alias("n")).where("n = 4")


#: Words are framed first, so that the mark goes around whole words only.
MARKED = r"""CASE WHEN list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), 'of') THEN regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{M}\p{N}]+)', chr(1) || '\1' || chr(2), 'g'), '(?i)\x01(of)\x02', '<em>\1</em>', 'g'), '[\x01\x02]', '', 'g') ELSE '' END"""


@C.query("x16_highlight", f"SELECT doc_id, {MARKED} AS snippet FROM documents")
def x16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", search.highlight(F.col("text"), ["of"]).alias("snippet"))


@C.query("t1_relevance_page", "SELECT doc_id, lang, source, round(score, 6) AS score FROM (" + bm25_sql(["the"]) + ") ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def t1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    hits = index.score(indexed(spark, sf), ["the"]).withColumnRenamed("id", "doc_id").join(docs, "doc_id")
    return search.page(hits, 10, 2, F.desc("score"), F.col("doc_id")).select("doc_id", "lang", "source", F.round("score", 6).alias("score"))


@C.query("a9_totals", f"SELECT least(count(*), 1000) AS total_hits, count(*) AS total_exact FROM {DOCS} WHERE list_contains(w, 'the')")
def a9(spark, sf):
    return search.totals(search.match_all(table(spark, sf, "documents"), "text", "the"))


@C.query("p1_result_projection", "SELECT doc_id AS document_id, 'src/' || source AS path, source AS filename, coalesce(nullif(n_chars, 0), 0)::DOUBLE AS score FROM documents")
def p1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), "source").alias("path"), F.nullif("n_chars", F.lit(0)).alias("rank"))
    return docs.select(F.col("doc_id").alias("document_id"), "path", scalars.basename(F.col("path")).alias("filename"), F.coalesce("rank", F.lit(0)).cast("double").alias("score"))


@C.query("p2_conditional_constant", "SELECT doc_id, CASE WHEN source LIKE '%1%' THEN CASE WHEN lang = 'fr' THEN 'orateur' ELSE 'speaker' END END AS label FROM documents")
def p2(spark, sf):
    label = F.when(F.contains("source", F.lit("1")), F.when(F.col("lang") == "fr", "orateur").otherwise("speaker"))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@C.query("p3_snippet", f"SELECT doc_id, CASE WHEN lang = 'en' THEN {MARKED} ELSE text END AS snippet FROM documents")
def p3(spark, sf):
    """English documents stand in for lexical hits, the others for vector hits."""
    lexical, vector = (search.snippet(F.col("text"), terms) for terms in (["of"], None))
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", lexical).otherwise(vector).alias("snippet"))


VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
NEAR = f"SELECT a.vec_id, a.label, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score FROM {VECTORS} a, {VECTORS} b WHERE b.vec_id = 7"


@C.query("t2_knn", f"SELECT vec_id, label, round(score, 6) AS score FROM ({NEAR}) ORDER BY score DESC, vec_id LIMIT 20")
def t2(spark, sf):
    rows = table(spark, sf, "embeddings")
    own = rows.where("vec_id = 7").first().embedding  # one vector of a request
    return search.nearest(rows, "embedding", own, 20, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@C.query("j11_filtered_knn", f"SELECT vec_id, label, round(score, 6) AS score FROM ({NEAR} AND a.label IN (1, 2)) ORDER BY score DESC, vec_id LIMIT 15")
def j11(spark, sf):
    rows = table(spark, sf, "embeddings")
    own = rows.where("vec_id = 7").first().embedding
    return search.nearest(search.in_categories(rows, {"label": [1, 2]}), "embedding", own, 15, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@C.query("t5_similar", f"SELECT vec_id, label, round(score, 6) AS score FROM ({NEAR} AND a.vec_id <> 7) ORDER BY score DESC, vec_id LIMIT 10")
def t5(spark, sf):
    return search.similar(table(spark, sf, "embeddings"), "vec_id", "embedding", 7).select("vec_id", "label", F.round("score", 6).alias("score"))


@C.query("j12_self_similarity", f"WITH s AS (SELECT a.vec_id AS query, b.vec_id, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id WHERE a.vec_id < 5) SELECT query, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 3")
def j12(spark, sf):
    from pyspark.sql import Window as W

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id < 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("own"))  # five vectors of a request
    scored = rows.join(F.broadcast(asked), F.col("vec_id") != F.col("query")).withColumn("score", (1 + search.cosine(F.col("embedding"), F.col("own"))) / 2)
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("n", best).where("n <= 3").select("query", "vec_id", F.round("score", 6).alias("score"))


@C.query("x18_cosine", f"SELECT a.vec_id, round((1 + list_cosine_similarity(a.v, b.v)) / 2, 6) AS score FROM {VECTORS} a JOIN {VECTORS} b ON b.vec_id = a.vec_id + 1")
def x18(spark, sf):
    rows = table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round((1 + search.cosine(F.col("embedding"), F.col("other"))) / 2, 6).alias("score"))


@C.query("f28_absent_vector", "SELECT vec_id FROM embeddings WHERE FALSE")
def f28(spark, sf):
    return search.nearest(table(spark, sf, "embeddings"), "embedding", None, 5, "vec_id").select("vec_id")


LEX = "SELECT doc_id, score FROM (" + bm25_sql(["the"]) + ")"
VEC = f"SELECT vec_id AS doc_id, score FROM ({NEAR})"


def _sides(spark, sf):
    lexical = index.score(indexed(spark, sf), ["the"]).withColumnRenamed("id", "doc_id")
    rows = table(spark, sf, "embeddings")
    own = rows.where("vec_id = 7").first().embedding
    vector = rows.select(F.col("vec_id").alias("doc_id"), ((1 + search.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in own]))) / 2).alias("score"))
    return lexical, vector


FUSED = f"""WITH l AS ({LEX}), v AS ({VEC}), ln AS (SELECT doc_id, score / (SELECT max(score) FROM l) AS x FROM l), vn AS (SELECT doc_id, score / (SELECT max(score) FROM v) AS x FROM v)
SELECT coalesce(ln.doc_id, vn.doc_id) AS doc_id, round(0.6 * coalesce(ln.x, 0) + 0.4 * coalesce(vn.x, 0), 6) AS score FROM ln FULL JOIN vn ON ln.doc_id = vn.doc_id"""


@C.query("j7_weighted_fusion", FUSED)
def j7(spark, sf):
    return search.fuse(*_sides(spark, sf), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@C.query("t4_fused_page", f"SELECT * FROM ({FUSED}) ORDER BY score DESC, doc_id LIMIT 10")
def t4(spark, sf):
    fused = search.fuse(*_sides(spark, sf), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))
    return search.page(fused, 10, 1, F.desc("score"), F.col("doc_id"))


@C.query("a7_best_per_key", "SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY l_orderkey")
def a7(spark, sf):
    return search.best_per_key(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "best")


@C.query("a8_max_normalised", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 6) AS share FROM orders")
def a8(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("share"))
    return search.max_normalised(orders, "share").select("o_orderkey", F.round("share", 6).alias("share"))


@C.query(
    "fuse_reciprocal_ranks",
    "WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 20), v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents QUALIFY rank < 20) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY doc_id",
)
def rrf(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    page = lambda *order: docs.orderBy(*order).limit(20)
    from pyspark.sql import Window as W

    ranked = lambda *order: page(*order).withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)  # a page of results
    fused = search.fuse_ranks(ranked(F.desc("n_chars"), F.col("doc_id")), ranked(F.col("doc_id")), "doc_id")
    return fused.select("doc_id", F.round("score", 6).alias("score"))


@C.query(
    "t3_rerank_page",
    "WITH h AS (SELECT doc_id, text, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30), r AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 7 % 11)::DOUBLE END AS s FROM h) SELECT doc_id, coalesce(s, 0.5::DOUBLE) AS score FROM r ORDER BY s DESC NULLS LAST, doc_id LIMIT 10",
)
def t3(spark, sf):
    hits = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", F.lit(0.5).alias("score"))
    scores = hits.where("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") * 7 % 11).cast("double").alias("rerank_score"))
    return search.rerank(hits, scores, "doc_id", 10, 1).select("doc_id", "score")


@C.query("u0_side_by_side", f"SELECT 'lexical' AS side, count(*) AS n FROM ({LEX}) UNION ALL SELECT 'vector', count(*) FROM ({VEC})")
def u0(spark, sf):
    lexical, vector = _sides(spark, sf)
    both = lexical.select(F.lit("lexical").alias("side")).unionByName(vector.select(F.lit("vector").alias("side")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@C.query("t13_text_cut", "SELECT doc_id, substr(text, 1, 1000) AS text FROM documents")
def t13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", models.seen_by_reranker(F.col("text")).alias("text"))


@C.query("x14_tokens", f"SELECT doc_id, len(w) AS n, array_to_string(w, '|') AS words FROM {DOCS}")
def x14(spark, sf):
    words = textnorm.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.array_join(words, "|").alias("words"))
