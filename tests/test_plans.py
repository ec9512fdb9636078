"""What the physical plans must look like."""

from pyspark.sql import functions as F

from granary.operators import models, search
from granary.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["f4_categories"](spark, sf))
    assert "PushedFilters: [In(lang" in text and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text
    assert "Python" not in text


def test_top_k_keeps_k_rows_per_task(spark, sf):
    assert "TakeOrderedAndProject" in plan(catalog.flagship(spark, sf))


def test_reranking_runs_above_the_limit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hits = docs.orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id", "text")
    text = plan(hits.select("doc_id", models.rerank_score(F.col("text"), "the").alias("s")))
    # Spark may score the k best of each task instead of the k best of all, never more.
    limit = min(text.index(x) for x in ("TakeOrderedAndProject", "GlobalLimit", "LocalLimit") if x in text)
    assert text.index("ArrowEvalPython") < limit


def test_query_frames_are_broadcast(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(search.phrase_by_positions(search.postings(docs, "doc_id", "text"), ["of", "the"]))
    assert "BroadcastHashJoin" in text
