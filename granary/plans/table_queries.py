"""Joins, aggregations, windows, sorting, set operations and state over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import scalars
from granary.operators import facets, logs, neighbours, overlay, search, state, suggest
from granary.plans.base import Catalog, fixed_in, table, values
from granary.session import shared_dir
from granary.sources import files
from granary.streaming import ingest

C = Catalog()
fixed = fixed_in(C)


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"


# Sources

PATHS = [("a/one.pdf",), ("a/TWO.PDF",), ("a/notes.txt",), ("skip/_ignore",), ("skip/x.pdf",), ("skip/deep/y.pdf",), (".hidden/z.pdf",), ("b/.dot.pdf",), ("b/page_0012.txt",), ("b/page_0003.json",)]
SEEN = "SELECT path FROM {rows} WHERE NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '(^|/)_ignore$') AND NOT starts_with(path, 'skip/')"


def on_paths(name: str, sql: str):
    def add(f):
        C.query(name, sql.replace("{rows}", values(PATHS, "path VARCHAR")))(lambda spark, sf: f(spark.createDataFrame(PATHS, "path string")))
        return f

    return add


@on_paths("s1_directory_scan", SEEN)
def s1(df):
    return state.without_ignored(df)


@on_paths("s2_pdf_filter", SEEN + " AND lower(path) LIKE '%.pdf'")
def s2(df):
    return files.pdf_files(state.without_ignored(df))


@on_paths("s10_page_numbers", r"SELECT path, TRY_CAST(nullif(regexp_extract(path, 'page_(\d+)\.[^/]*$', 1), '') AS INTEGER) AS page FROM {rows}")
def s10(df):
    return df.select("path", files.page_number(F.col("path")).alias("page"))


@on_paths("s29_page_files", r"SELECT DISTINCT path FROM {rows} WHERE regexp_matches(path, '(^|/)page_\d{4}\.(txt|json)$')")
def s29(df):
    return files.page_files(df)


@C.query("s6_page_texts", "SELECT doc_id, i - 1 AS position, trim(p) AS text FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(p) <> ''")
def s6(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(files.SEPARATOR)).alias("value"))
    return files.page_paragraphs(pages, "value").withColumn("position", F.col("position").cast("long"))


@C.query("s8_page_writer", "SELECT CAST(o_custkey AS VARCHAR) AS document_id, 1 AS page_num, string_agg(o_orderpriority, chr(10) || '----' || chr(10) ORDER BY o_orderkey) AS value, 'page_0001.txt' AS file FROM orders GROUP BY o_custkey")
def s8(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.lit(1).alias("page_num"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("text"))
    return files.page_texts(rows)


@C.query("s9_complete_documents", "SELECT CAST(l_orderkey AS VARCHAR) AS document_id FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity <= 5) = 0")
def s9(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page_num"), "l_quantity")
    return files.complete_documents(items.select("document_id", "page_num").distinct(), items.groupBy("document_id", "page_num").agg(F.min("l_quantity").alias("q")).where("q > 5").select("document_id", "page_num"))


@C.query("s21_full_scan", "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q FROM lineitem")
def s21(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@C.query("s22_point_read", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def s22(spark, sf):
    return table(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


LOG = [("x Stripped: 'Page 12' y",), ("matched: 'ab'",), ("matched: 'a longer heading here'",), ("nothing",)]


@fixed("s25_log_texts", LOG, "value VARCHAR", "SELECT text FROM (SELECT coalesce(nullif(regexp_extract(value, 'Stripped: ''(.*)''', 1), ''), nullif(regexp_extract(value, 'matched: ''(.*)''', 1), '')) AS text FROM {rows}) WHERE length(text) BETWEEN 3 AND 12")
def s25(df):
    return logs.log_texts(df, "value", 3, 12)


@C.query("s16_s17_table_life", "SELECT r_regionkey, r_name FROM region")
def s16(spark, sf):
    """Made once though asked for twice, filled, and dropped; the files of the table outlive its name."""
    name, path = f"granary_{uuid.uuid4().hex}", _folder(spark)
    for _ in range(2):
        files.ensure_table(spark, name, "r_regionkey int, r_name string", path)
    table(spark, sf, "region").select("r_regionkey", "r_name").write.insertInto(name)
    files.drop_tables(spark, [name, name])
    return spark.read.schema("r_regionkey int, r_name string").parquet(path)


@C.query("s26_snapshot_restore", "SELECT n_nationkey, n_name FROM nation")
def s26(spark, sf):
    """A table that was changed after a snapshot is as it was after restoring."""
    root, nation = _folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name")
    files.write_snapshot({"nation": nation}, f"{root}/snapshots", "s1")
    nation.withColumn("n_name", F.lit("changed")).write.parquet(f"{root}/live/nation")
    return files.restore_into(spark, f"{root}/snapshots", f"{root}/live")["nation"]


@C.query("z1_z3_ingest_once", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def z1(spark, sf):
    """Two runs over the same files take each document once."""
    root, schema = _folder(spark), table(spark, sf, "documents").select("doc_id", "lang", "n_chars").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    for _ in range(2):
        ingest.ingest(stream, ["doc_id"], lambda df, _: df.write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint")
    return spark.read.schema(schema).parquet(f"{root}/out").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


# Facets and aggregations


@C.query("a3_facets", "SELECT lang AS content_type, 'source' AS key, list_sort(list(DISTINCT source)) AS vals FROM documents GROUP BY lang")
def a3(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    return facets.facets(docs, ["lang"], {"source": F.col("source")}).select(F.col("lang").alias("content_type"), "key", F.col("values").alias("vals"))


@C.query(
    "a4_date_ranges",
    "SELECT o_orderpriority AS value, count(*) AS n_ranges, min(s) AS first_start, max(e) AS last_end FROM (SELECT DISTINCT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS s, CAST(last_day(o_orderdate) AS DATE) AS e FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_orderpriority",
)
def a4(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.lit("all").alias("g"), "o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("s"), F.last_day("o_orderdate").alias("e"))
    ranges = facets.date_ranges(rows, ["g"], "o_orderpriority", "s", "e").select(F.explode("ranges").alias("value", "list"))
    return ranges.select("value", F.size("list").cast("long").alias("n_ranges"), F.array_min(F.transform("list", lambda r: r["start_date"])).alias("first_start"), F.array_max(F.transform("list", lambda r: r["end_date"])).alias("last_end"))


@C.query("a5_facet_rebuild", "SELECT k AS key, list_sort(list(DISTINCT v)) AS vals FROM (SELECT 'segment' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY k")
def a5(spark, sf):
    rows = table(spark, sf, "customer").select(F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("m"))
    return facets.facets_of_map(rows, [], "m").select("key", F.col("values").alias("vals"))


@C.query("a6_facets_of_distinct", "SELECT p_brand AS brand, list_sort(list(DISTINCT CAST(p_size AS VARCHAR))) AS vals FROM part GROUP BY p_brand")
def a6(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_size").dropDuplicates()
    return facets.facets(rows, ["p_brand"], {"size": F.col("p_size")}).select(F.col("p_brand").alias("brand"), F.col("values").alias("vals"))


@C.query("p11_p12_composite_keys", "SELECT DISTINCT source || '_' || lang AS key, source AS field FROM documents WHERE source IN ('src1', 'src2')")
def p11(spark, sf):
    keys = table(spark, sf, "documents").select(facets.composite_key(F.col("source"), F.col("lang")).alias("key")).distinct()
    return keys.withColumn("field", facets.field_of_key(F.col("key"))).where(F.col("field").isin("src1", "src2"))


@C.query("p13_facet_pivot", "SELECT region AS content_type, 'all' AS language, count(*) AS n_fields, sum(n)::BIGINT AS n_values FROM (SELECT n_regionkey AS region, substr(n_name, 1, 1) AS k, count(DISTINCT n_name) AS n FROM nation GROUP BY ALL) GROUP BY region")
def p13(spark, sf):
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("content_type"), F.substring("n_name", 1, 1).alias("key")).agg(F.array_sort(F.collect_set("n_name")).alias("values")).withColumn("language", F.lit("all"))
    fields = F.map_values("fields")
    return facets.pivot_facets(rows).select("content_type", "language", F.size("fields").cast("long").alias("n_fields"), F.aggregate(fields, F.lit(0).cast("long"), lambda s, v: s + F.size(v)).alias("n_values"))


@C.query("j19_merged_facets", "SELECT key, list_sort(list(DISTINCT v)) AS vals FROM (SELECT lang AS key, source AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, 'x' || source FROM documents WHERE doc_id % 3 = 0) GROUP BY key")
def j19(spark, sf):
    docs = table(spark, sf, "documents")
    side = lambda where, v: docs.where(where).groupBy(F.col("lang").alias("key")).agg(F.array_sort(F.collect_set(v)).alias("values"))
    return facets.merge_facets(side("doc_id % 2 = 0", F.col("source")), side("doc_id % 3 = 0", F.concat(F.lit("x"), "source"))).select("key", F.col("values").alias("vals"))


RECORDS = "(SELECT ts AS timestamp, CASE WHEN user_id % 7 = 0 THEN '10.0.0.' || (user_id % 5) ELSE '8.8.' || (user_id % 9) || '.1' END AS client_ip, CASE event_type WHEN 'click' THEN 'lexical' WHEN 'view' THEN 'vector' ELSE event_type END AS search_type, value AS latency_ms, CAST(event_id % 4 AS INTEGER) AS total_results FROM events)"


def _records(spark, sf):
    kind = F.when(F.col("event_type") == "click", "lexical").when(F.col("event_type") == "view", "vector").otherwise(F.col("event_type"))
    ip = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 5)).otherwise(F.concat(F.lit("8.8."), F.col("user_id") % 9, F.lit(".1")))
    return table(spark, sf, "events").select(F.col("ts").alias("timestamp"), ip.alias("client_ip"), kind.alias("search_type"), F.col("value").alias("latency_ms"), (F.col("event_id") % 4).cast("int").alias("total_results"))


@C.query(
    "a11_log_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (search_type = 'lexical') AS lexical, count(*) FILTER (search_type = 'vector') AS vector, count(*) FILTER (total_results = 0) AS zero_results,
round(100.0::DOUBLE * count(*) FILTER (search_type = 'lexical') / count(*), 4) AS lexical_pct, round(100.0::DOUBLE * count(*) FILTER (search_type = 'vector') / count(*), 4) AS vector_pct, round(100.0::DOUBLE * count(*) FILTER (total_results = 0) / count(*), 4) AS zero_pct,
round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(total_results), 6) AS avg_results, count(DISTINCT client_ip) AS unique_ips, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_at FROM {RECORDS}""",
)
def a11(spark, sf):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    out = logs.summary(_records(spark, sf))
    return out.select(*[at(c) if c in ("first_at", "last_at") else F.col(c) for c in out.columns])


@C.query("a11_by_day", f"SELECT CAST(timestamp AS DATE) AS date, search_type, count(*) AS n FROM {RECORDS} GROUP BY ALL")
def a11b(spark, sf):
    return logs.with_time_parts(_records(spark, sf)).groupBy("date", "search_type").agg(F.count("*").alias("n"))


@C.query("p15_time_parts", f"SELECT client_ip, hour(timestamp)::INTEGER AS hour, dayname(timestamp) AS day_of_week, CAST(timestamp AS DATE) AS date, total_results > 0 AS has_results FROM {RECORDS}")
def p15(spark, sf):
    return logs.with_time_parts(_records(spark, sf)).select("client_ip", "hour", "day_of_week", "date", "has_results")


@C.query("s24_csv_export", f"SELECT client_ip, search_type, total_results::VARCHAR AS total_results, hour(timestamp)::VARCHAR AS hour, dayname(timestamp) AS day_of_week, (total_results > 0)::VARCHAR AS has_results, NULL::VARCHAR AS country, 22 AS n_columns FROM {RECORDS}")
def s24(spark, sf):
    path = _folder(spark)
    logs.write_csv(_records(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("client_ip", "search_type", "total_results", "hour", "day_of_week", "has_results", "country", F.lit(len(back.columns)).alias("n_columns"))


LINES = [("2024-01-02 03:04:05,8.8.8.8,राम; सीता,lexical,True,{},hi,False,10,1,12.5,3",), ("bad time,1.1.1.1,q,vector,False,{},hi,False,10,1,1.0,0",), ("2024-01-02 03:04:05,1.1.1.1,q,vector,False,{},hi,False,ten,1,1.0,0",), ("too,few",), ("2024-01-03 00:00:00,10.0.0.1,q,vector,false,{},gu,true,5,2,99.0,0",)]


@fixed("s23_f22_log_parser", LINES, "value VARCHAR", "SELECT strftime(try_strptime(f[1], '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS at, f[2] AS client_ip, f[3] AS query, lower(f[5]) = 'true' AS exact_match, CAST(f[9] AS INTEGER) AS page_size, CAST(f[11] AS DOUBLE) AS latency_ms, CAST(f[12] AS INTEGER) AS total_results FROM (SELECT string_split(value, ',') AS f FROM {rows}) WHERE len(f) >= 12 AND try_strptime(f[1], '%Y-%m-%d %H:%M:%S') IS NOT NULL AND TRY_CAST(f[9] AS INTEGER) IS NOT NULL")
def s23(df):
    return logs.parse(df).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "client_ip", "query", "exact_match", "page_size", "latency_ms", "total_results")


@C.query("j18_geolocation", f"SELECT country, count(*) AS n FROM (SELECT CASE WHEN client_ip LIKE '10.%' THEN 'Local' WHEN client_ip IN ('8.8.1.1', '8.8.2.1') THEN 'IN' ELSE 'Unknown' END AS country FROM {RECORDS}) GROUP BY country")
def j18(spark, sf):
    places = spark.createDataFrame([("8.8.1.1", "IN"), ("8.8.2.1", "IN")], "client_ip string, country string")
    return logs.located(_records(spark, sf), places).groupBy("country").agg(F.count("*").alias("n"))


@C.query("a13_catalogue", "SELECT o_orderpriority AS language, count(*) AS series, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 10 END), 0)::BIGINT AS searchable_items, count(*) FILTER (o_orderstatus = 'F') AS searchable, count(*) FILTER (o_orderstatus = 'O') AS in_progress, count(*) FILTER (o_orderstatus = 'P') AS planned FROM orders GROUP BY o_orderpriority")
def a13(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "searchable").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("planned")
    return facets.catalogue(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("language"), status.alias("status"), (F.col("o_orderkey") % 10).alias("count")))


@C.query("a14_distinct", "SELECT DISTINCT p_type FROM part")
def a14(spark, sf):
    return table(spark, sf, "part").select("p_type").distinct()


@C.query("a15_years", "SELECT DISTINCT CAST(y AS INTEGER) AS year FROM (SELECT unnest(generate_series(year(min(o_orderdate)), year(max(o_orderdate)))) AS y FROM orders GROUP BY o_custkey)")
def a15(spark, sf):
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return facets.years(spans, "s", "e")


@C.query("a16_weighted_score", "SELECT l_orderkey, l_linenumber, round(0.6 * l_discount / (SELECT max(l_discount) FROM lineitem) + 0.4 * l_tax / (SELECT max(l_tax) FROM lineitem), 6) AS score FROM lineitem")
def a16(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    shares = search.max_normalised(search.max_normalised(items, "l_discount"), "l_tax")
    return shares.select("l_orderkey", "l_linenumber", F.round(search.weighted(F.col("l_discount"), F.col("l_tax")), 6).alias("score"))


# Joins


@C.query("j1_bookmark_join", "SELECT o_orderkey AS idx, arg_max(l_shipdate, l_linenumber) IS NOT NULL AS dated, max(l_linenumber) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def j1(spark, sf):
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(F.max_by(F.struct("l_shipdate", "l_linenumber"), "l_linenumber").alias("r"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx")).join(last, "idx").select("idx", F.col("r.l_shipdate").isNotNull().alias("dated"), F.col("r.l_linenumber").alias("last"))


MARKS = [("h", 0, 2, "248", "23-10-1985"), ("h", 1, 4, "324", "24-05-1986"), ("j", 0, 1, "10", "03-05-1986"), ("j", 1, 5, None, "04-06-1987"), ("j", 2, 6, "99", None), ("k", 0, 0, "1", "01-01-2000")]
BOOKS = [("h", 5), ("j", 6), ("k", 2), ("m", 1)]
MARKS_SQL = values(MARKS, "document_id VARCHAR, pos INTEGER, page INTEGER, pravachan_no VARCHAR, date VARCHAR")


@C.query(
    "j2_w1_page_fill",
    f"WITH s AS (SELECT document_id, CAST(unnest(generate_series(1, total_pages)) AS INTEGER) AS page FROM {values(BOOKS, 'document_id VARCHAR, total_pages INTEGER')}) SELECT s.document_id, s.page, m.pravachan_no, m.date FROM s LEFT JOIN {MARKS_SQL} m ON m.document_id = s.document_id AND m.date IS NOT NULL AND greatest(m.page, 1) <= s.page QUALIFY row_number() OVER (PARTITION BY s.document_id, s.page ORDER BY m.page DESC NULLS LAST, m.pos DESC) = 1",
)
def j2(spark, sf):
    marks = spark.createDataFrame(MARKS, "document_id string, pos int, page int, pravachan_no string, date string")
    return neighbours.fill_pages(marks, spark.createDataFrame(BOOKS, "document_id string, total_pages int"))


#: A folder per region, one per nation in it, and a file per supplier.
PLACES_SQL = "(SELECT r_name AS region, r_name || '/' || n_name AS dir, r_name || '/' || n_name || '/' || s_name || '.pdf' AS path, * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _places(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.withColumns({"region": F.col("r_name"), "dir": F.concat_ws("/", "r_name", "n_name"), "path": F.concat(F.concat_ws("/", "r_name", "n_name", "s_name"), F.lit(".pdf"))})


@C.query(
    "j3_config_overlay",
    f"""WITH e AS (SELECT path, 0 AS depth, unnest(['language', 'type']) AS k, unnest(['xx', 'base']) AS v FROM {PLACES_SQL}
UNION ALL SELECT path, 1, unnest(['language', 'category']), unnest([lower(region), 'c' || r_regionkey]) FROM {PLACES_SQL}
UNION ALL SELECT path, 2, unnest(['type', 'category']), unnest([n_name, n_name]) FROM {PLACES_SQL} WHERE n_nationkey % 2 = 0
UNION ALL SELECT path, 3, 'language', s_name FROM {PLACES_SQL} WHERE s_acctbal < 0),
f AS (SELECT path, k, arg_max(v, depth) AS v FROM e GROUP BY ALL)
SELECT path, string_agg(k || '=' || v, ';' ORDER BY k) AS config FROM f GROUP BY path""",
)
def j3(spark, sf):
    places = _places(spark, sf)
    pair = lambda *cells: F.create_map(*cells).alias("config")
    base = spark.createDataFrame([("", {"language": "xx", "type": "base"})], "dir string, config map<string,string>")
    regions = table(spark, sf, "region").select(F.col("r_name").alias("dir"), pair(F.lit("language"), F.lower("r_name"), F.lit("category"), F.concat(F.lit("c"), "r_regionkey")))
    nations = places.where("n_nationkey % 2 = 0").select("dir", pair(F.lit("type"), F.col("n_name"), F.lit("category"), F.col("n_name")), "n_nationkey").dropDuplicates(["n_nationkey"]).drop("n_nationkey")
    own = places.where("s_acctbal < 0").select("path", pair(F.lit("language"), F.col("s_name")))
    out = overlay.merged_config(places.select("path"), base.unionByName(regions).unionByName(nations), own)
    entries = F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("path", F.array_join(entries, ";").alias("config"))


@C.query("j3_inherited_value", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal < 0 THEN s_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS inherited FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3b(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumns({"own": F.when(F.col("s_acctbal") < 0, F.col("s_name")), "mid": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))})
    return rows.select("s_suppkey", overlay.inherit(rows, "s_suppkey", ["r_name", "mid", "own"]).alias("inherited"))


@C.query(
    "j4_scan_settings",
    f"""SELECT path, concat_ws(',', region, n_name, CASE WHEN s_acctbal > 0 THEN s_name END) AS header_prefix, 't' || n_nationkey AS typos, CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 3 END AS psm,
CASE WHEN n_nationkey % 3 = 0 THEN 'deep' END AS chunk_strategy, 10 + r_regionkey AS crop_top, 20 AS crop_bottom, CASE WHEN s_acctbal > 0 AND s_suppkey % 3 > 0 THEN 1 END AS start_page, CASE WHEN s_acctbal > 0 AND s_suppkey % 3 > 0 THEN CAST(s_suppkey % 3 AS INTEGER) END AS end_page FROM {PLACES_SQL}""",
)
def j4(spark, sf):
    """Lists add up along region and nation, the deepest scalar counts, and a file's section counts in its own folder only."""
    places = _places(spark, sf)
    none, no_int = F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    lists = lambda **given: [given.get(c, none).alias(c) for c in overlay.LISTS]
    one = lambda value: F.array(value)
    region = table(spark, sf, "region").select(
        F.col("r_name").alias("dir"), *lists(header_prefix=one(F.col("r_name"))), F.lit(3).alias("psm"), F.lit(None).cast("string").alias("chunk_strategy"), F.lit(None).cast("boolean").alias("ignore_bookmarks"),
        (F.col("r_regionkey") + 10).alias("crop_top"), no_int.alias("crop_bottom"),
    )
    nation = places.dropDuplicates(["n_nationkey"]).select(
        "dir", *lists(header_prefix=one(F.col("n_name")), typo_list=one(F.concat(F.lit("t"), "n_nationkey"))), F.when(F.col("n_nationkey") % 2 == 0, 6).alias("psm"), F.when(F.col("n_nationkey") % 3 == 0, "deep").alias("chunk_strategy"),
        F.lit(True).alias("ignore_bookmarks"), no_int.alias("crop_top"), F.lit(20).alias("crop_bottom"),
    )
    section = lambda at, name, end: [F.col(at).alias("dir"), F.col("path"), *lists(header_prefix=one(name), typo_list=one(F.lit("no"))), F.lit("u").alias("file_url"), F.lit(1).alias("start_page"), end.alias("end_page")]
    own = places.where("s_acctbal > 0").select(*section("dir", F.col("s_name"), (F.col("s_suppkey") % 3).cast("int")))
    never = places.select(*section("region", F.lit("never"), F.lit(9)))
    out = overlay.scan_settings(places.select("path"), region.unionByName(nation), own.unionByName(never))
    return out.select("path", F.array_join("header_prefix", ",").alias("header_prefix"), F.array_join("typo_list", ",").alias("typos"), "psm", "chunk_strategy", "crop_top", "crop_bottom", "start_page", "end_page")


@C.query("j5_page_data", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey")
def j5(spark, sf):
    pages = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(pages, "l_orderkey", "left")


@C.query("j6_positional_scores", "SELECT i - 1 AS position, v AS score FROM (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM (SELECT embedding AS e FROM embeddings WHERE vec_id = 1))")
def j6(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id = 1").select(F.posexplode("embedding").alias("position", "score"))
    return rows.select(F.col("position").cast("long").alias("position"), "score")


@C.query("j8_vanished", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j8(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return state.vanished(table(spark, sf, "customer").select("c_custkey"), seen, "c_custkey")


@C.query("j9_changes", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer")
def j9(spark, sf):
    now = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("config_hash"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("ocr_checksum"))
    before = now.where("c_custkey % 5 <> 0").withColumn("config_hash", F.when(F.col("c_custkey") % 7 == 0, "old").otherwise(F.col("config_hash")))
    return state.changes(now, before, "c_custkey", ["config_hash", "ocr_checksum"]).select("c_custkey", "change")


@C.query("j14_similar_words", "WITH v AS (SELECT c_name AS token, 1 AS df FROM customer), w AS (SELECT DISTINCT substr(token, 1, 9) || 'x' || substr(token, 11) AS word FROM v), c AS (SELECT word, token, df, levenshtein(word, token) AS d FROM w JOIN v ON substr(word, 1, 1) = substr(token, 1, 1) WHERE word NOT IN (SELECT token FROM v) AND length(word) >= 3) SELECT word, row_number() OVER (PARTITION BY word ORDER BY 1 - d::DOUBLE / least(length(word), length(token)) DESC, df DESC, token)::INTEGER AS rank, token AS option, round(1 - d::DOUBLE / least(length(word), length(token)), 6) AS score FROM c WHERE d BETWEEN 1 AND 2 AND 1 - d::DOUBLE / least(length(word), length(token)) >= 0.6 QUALIFY rank <= 3")
def j14(spark, sf):
    vocabulary = table(spark, sf, "customer").select(F.col("c_name").alias("token"), F.lit(1).alias("df"))
    words = vocabulary.select(F.concat(F.substring("token", 1, 9), F.lit("x"), F.substring("token", 11, 100)).alias("word"))
    return suggest.similar_words(words, vocabulary).select("word", "rank", "option", F.round("score", 6).alias("score"))


VARIANTS = [("ram", 1, "राम", 9), ("ram", 2, "रम", 0), ("ram", 7, "रैम", 3), ("sita", 6, "सीता", 4), ("sita", 7, "सिता", 2), ("xyz", 1, "क्स", 0)]
VARIANTS_SQL = values(VARIANTS, "word VARCHAR, rank INTEGER, variant VARCHAR, freq INTEGER")


def _variants(spark):
    rows = spark.createDataFrame(VARIANTS, "word string, rank int, variant string, freq int")
    return rows.select("word", "rank", "variant"), rows.select("variant", "freq")


@C.query("j15_f24_t7_known_variants", f"SELECT word, rank, variant, freq FROM {VARIANTS_SQL} WHERE freq > 0")
def j15(spark, sf):
    return suggest.known_variants(*_variants(spark)).select("word", "rank", "variant", "freq")


@C.query("u7_tiered_variants", f"SELECT word, tier, variant, freq FROM (SELECT *, CASE WHEN rank <= 5 THEN 1 ELSE 2 END AS tier FROM {VARIANTS_SQL} WHERE freq > 0) QUALIFY tier = min(tier) OVER (PARTITION BY word)")
def u7(spark, sf):
    return suggest.tiered_variants(*_variants(spark))


@C.query("j16_t6_phrases", "WITH a AS (SELECT p_brand AS v, count(*) AS f FROM part GROUP BY 1 ORDER BY f DESC, v LIMIT 3), b AS (SELECT p_type AS v, count(*) AS f FROM part GROUP BY 1 ORDER BY f DESC, v LIMIT 3) SELECT a.v || ' ' || b.v AS phrase, a.f + b.f AS score FROM a, b ORDER BY score DESC, phrase LIMIT 5")
def j16(spark, sf):
    part = table(spark, sf, "part")
    option = lambda c: part.groupBy(F.col(c).alias("variant")).agg(F.count("*").alias("freq"))
    return suggest.phrases([option("p_brand"), option("p_type")], k=5)


@fixed("j16_phrase_product", [("x",)], "k VARCHAR", "SELECT a || ' ' || b || ' ' || c AS phrase FROM (VALUES ('यह'), ('ये')) t(a), (VALUES ('कौन')) u(b), (VALUES ('था'), ('था?')) w(c)")
def j16b(df):
    lists = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in (["यह", "ये"], ["कौन"], ["था", "था?"])])
    return df.select(F.explode(suggest.phrase_product(lists)).alias("phrase"))


@C.query("x32_recombine", "WITH r AS (SELECT n_nationkey, [n_name, 'fast', r_name] AS w, [[substr(n_name, 1, 2), substr(n_name, 1, 3), substr(n_name, 1, 2), 'fourth'], [], CASE WHEN n_nationkey % 2 = 0 THEN [lower(r_name)] ELSE [] END] AS o FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT n_nationkey, array_to_string(list_transform([1, 2, 3], lambda j: CASE WHEN len(o[j]) = 0 THEN w[j] ELSE o[j][least(i, len(o[j]))] END), ' ') AS suggestion FROM r, unnest([1, 2, 3]) t(i)")
def x32(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = lambda n: F.substring("n_name", 1, n)
    none = F.array().cast("array<string>")
    options = F.array(F.array(head(2), head(3), head(2), F.lit("fourth")), none, F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lower("r_name"))).otherwise(none))
    return rows.select("n_nationkey", F.explode(suggest.recombine(F.array(F.col("n_name"), F.lit("fast"), F.col("r_name")), options)).alias("suggestion"))


@C.query("j17_corpus_diff", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'different' ELSE 'matching' END AS verdict FROM documents")
def j17(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "text")
    other = base.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return state.compare(base, other, "doc_id", "text")


@C.query("j20_metadata_update", "SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE source END AS source FROM documents")
def j20(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return state.metadata_update(docs, docs.where("doc_id % 10 = 3").select("doc_id", F.lit("new").alias("source")), "doc_id")


# Windows


@C.query("w1_forward_fill", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def w1(spark, sf):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return neighbours.forward_fill(table(spark, sf, "events"), "user_id", ["ts", "event_id"], value, "last_purchase").select("event_id", "user_id", "last_purchase")


PARAS = "(SELECT doc_id, i - 1 AS position, p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def _paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "p")).withColumn("position", F.col("position").cast("long"))


@C.query("w2_ordinals", f"SELECT doc_id, position, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS ordinal FROM {PARAS} WHERE length(p) > 50")
def w2(spark, sf):
    rows = _paragraphs(spark, sf).where("length(p) > 50")
    return neighbours.ordinals(rows, "doc_id", ["position"]).select("doc_id", "position", F.col("ordinal").cast("long").alias("ordinal"))


@C.query("w3_context", f"SELECT doc_id, position, lag(p) OVER w AS previous_p, lead(p) OVER w AS next_p FROM {PARAS} WINDOW w AS (PARTITION BY doc_id ORDER BY position)")
def w3(spark, sf):
    return neighbours.context(_paragraphs(spark, sf), "doc_id", ["position"], ["p"]).select("doc_id", "position", "previous_p", "next_p")


@C.query("j13_neighbour_join", f"SELECT a.doc_id, a.position, b.position AS other FROM {PARAS} a JOIN {PARAS} b ON a.doc_id = b.doc_id AND b.position IN (a.position - 1, a.position + 1)")
def j13(spark, sf):
    rows = _paragraphs(spark, sf).select("doc_id", "position")
    asked = rows.select("doc_id", "position", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("other"))
    return asked.join(rows.withColumnRenamed("position", "other"), ["doc_id", "other"]).select("doc_id", "position", "other")


@C.query("w4_run_lengths", "WITH r AS (SELECT *, sum(CASE WHEN role = p AND role IN ('user', 'assistant') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)) SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text, min(turn) AS turn FROM r GROUP BY conv_id, island, role")
def w4(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("page", F.col("turn"))
    return neighbours.merge_runs(rows, "conv_id", ["turn"], "role", ["user", "assistant"], "text", "page").select("conv_id", "role", "text", F.col("page").alias("turn"))


@C.query("w5_sentence_runs", f"WITH r AS (SELECT *, sum(CASE WHEN prev IS NULL OR starts_with(p, 'The') OR ends_with(prev, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS island FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY position) AS prev FROM {PARAS})) SELECT doc_id, string_agg(p, ' ' ORDER BY position) AS p, min(position) AS page FROM r GROUP BY doc_id, island")
def w5(spark, sf):
    rows = _paragraphs(spark, sf).withColumn("page", F.col("position"))
    return neighbours.merge_sentences(rows, "doc_id", ["position"], "p", "page", ["The"], ["."]).select("doc_id", "p", "page")


@C.query("w9_carry_heading", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events WHERE event_type IN ('signup', 'view')")
def w9(spark, sf):
    rows = table(spark, sf, "events").where("event_type IN ('signup', 'view')")
    return neighbours.forward_fill(rows, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "heading")


@C.query("w10_shared_sequence", "SELECT l_orderkey, l_linenumber, (coalesce(sum(CAST(l_quantity AS BIGINT) % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS seq_num FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)")
def w10(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    out = neighbours.sequence_starts(rows, "l_orderkey", ["l_linenumber"], F.col("q").cast("long") % 3)
    return out.select("l_orderkey", "l_linenumber", F.col("seq_num").cast("long").alias("seq_num"))


@C.query("w11_cache_eviction", "SELECT p_partkey FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS before FROM part) WHERE before < 2000")
def w11(spark, sf):
    entries = table(spark, sf, "part").select("p_partkey", "p_size")
    return neighbours.evict_oldest(entries, "p_size", "p_partkey", 2000, F.floor(F.col("p_partkey") / 50)).select("p_partkey")


# Sorting and limits


@C.query("t8_first_options", "SELECT vec_id, embedding[1:3] AS first FROM embeddings")
def t8(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("first"))


@C.query("t9_status_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 99 END, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def t9(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "searchable").when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "P", "planned")
    order = [facets.status_rank(status), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = table(spark, sf, "orders").orderBy(*order).limit(50)
    return top.select("o_orderkey", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))  # one page


@C.query("t10_page_slice", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 40")
def t10(spark, sf):
    return search.page(table(spark, sf, "supplier").select("s_suppkey"), 20, 3, F.col("s_suppkey"))


@C.query("t11_page_links", "WITH c AS (SELECT n_nationkey + 1 AS current, (SELECT count(*) FROM nation) AS total FROM nation), p AS (SELECT current, page, page - lag(page) OVER (PARTITION BY current ORDER BY page) AS step FROM c, unnest(generate_series(1, total)) t(page) WHERE total <= 7 OR page <= 2 OR page >= total - 1 OR abs(page - current) <= 1) SELECT current, CAST(page AS INTEGER) AS page FROM p UNION ALL SELECT current, NULL FROM p WHERE step > 1")
def t11(spark, sf):
    """A pager for each place in the list of nations."""
    total = table(spark, sf, "nation").count()
    return spark.createDataFrame([(c, p) for c in range(1, total + 1) for p in scalars.page_links(total, c)], "current int, page int")


@C.query("f23_score_threshold", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.06")
def f23(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount >= 0.06").select("l_orderkey", "l_linenumber", "l_discount")


# Set operations


@C.query("u1_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'ADDED'")
def u1(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = old.where("c_custkey % 10 = 0").withColumn("segment", F.lit("UPDATED")).unionByName(spark.createDataFrame([(-1, "ADDED")], "c_custkey long, segment string"))
    return state.upsert(old, new, "c_custkey")


@C.query("u2_partial_update", "SELECT c_custkey, c_name AS bookmarks, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS version FROM customer")
def u2(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("bookmarks"), F.lit(0).alias("version"))
    new = old.where("c_custkey % 4 = 0").withColumns({"bookmarks": F.lit(None).cast("string"), "version": F.lit(1)})
    return state.update_keeping(old, new, "c_custkey", ["bookmarks"])


@C.query("u3_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def u3(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return state.delete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@C.query("u4_reindex", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 <> 1 UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 1) GROUP BY l_orderkey")
def u4(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey")
    return state.reindex(old, old.where("l_orderkey % 10 = 1").distinct(), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@C.query("u5_union_of_kinds", "SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_acctbal, c_mktsegment FROM customer")
def u5(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return supplier.unionByName(customer, allowMissingColumns=True)


RANGES = [("a", 1, 3), ("a", 3, 5), ("a", 9, 9), ("b", 2, 2)]


@fixed("u6_page_ranges", RANGES, "k VARCHAR, s INTEGER, e INTEGER", "SELECT k, array_to_string(list_sort(list(DISTINCT p)), ',') AS pages FROM (SELECT k, unnest(generate_series(s, e)) AS p FROM {rows}) GROUP BY k")
def u6(df):
    rows = df.groupBy("k").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("r"))
    return rows.select("k", F.array_join(F.transform(overlay.page_set(F.col("r")), lambda p: p.cast("string")), ",").alias("pages"))


@C.query("u7_missing_pages", "SELECT o_orderkey AS document_id, CAST(p AS INTEGER) AS page_num FROM (SELECT o_orderkey, unnest(generate_series(1, 3)) AS p FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = p)")
def u7b(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_num"))
    return overlay.missing_pages(wanted, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_num")))


@fixed("u8_ordered_dedupe", [("b,a,b,c,a",), ("",)], "t VARCHAR", "SELECT t, CASE t WHEN '' THEN '' ELSE 'b,a,c' END AS r FROM {rows}")
def u8(df):
    return df.select("t", F.array_join(F.array_distinct(F.split("t", ",")), ",").alias("r"))


# Event windows (extension)


@C.query("ext_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext1(spark, sf):
    out = ingest.counts_by_window(table(spark, sf, "events"), "ts", "1 hour", by=("event_type",))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@C.query("ext_sliding_windows", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY s")
def ext2(spark, sf):
    return ingest.counts_by_window(table(spark, sf, "events"), "ts", "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@C.query("ext_sessions", "WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s")
def ext3(spark, sf):
    return ingest.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@C.query("z7_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def z7(spark, sf):
    return ingest.last_turns(table(spark, sf, "conversations"), "conv_id", F.col("turn")).select("conv_id", "turn", "role")
