"""Scalar and text queries on fixed rows and on the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scalars, textnorm
from granary.operators import facets, logs
from granary.operators.paragraphs import starts_with
from granary.plans.base import Catalog, fixed_in, table, values

C = Catalog()


fixed = fixed_in(C)


SPACES = [("Test with​special characters﻿",), ("a b",), ("plain text",), ("",)]


@fixed("x1_repair_spaces", SPACES, "t VARCHAR", "SELECT t, replace(replace(replace(replace(replace(t, chr(160), ' '), chr(8201), ' '), chr(8239), ' '), chr(8203), ''), chr(65279), '') AS r FROM {rows}")
def x1(df):
    return df.select("t", textnorm.repair_spaces(F.col("t")).alias("r"))


DANDAS = [("यह है|",), ("Il1॥",), ("।",), ("दो॥ तीन l",)]


@fixed("x2_repair_dandas", DANDAS, "t VARCHAR", "SELECT t, translate(t, '|Il1॥', '।।।।।') AS r FROM {rows}")
def x2(df):
    return df.select("t", textnorm.repair_dandas(F.col("t")).alias("r"))


MARKS = [("( a ) b , c !",), ("say \" hi \" now",), ("wait ... what .. ok",), ("[ x ]; y : z ?",)]
TIGHT = r"regexp_replace(regexp_replace(regexp_replace(t, '([(\[{''\"])\s+', '\1', 'g'), '\s+([।.,?!:;)\]}''\"])', '\1', 'g'), '\s+(\.{2,})', '\1', 'g')"


@fixed("x3_x5_tighten_punctuation", MARKS, "t VARCHAR", f"SELECT t, {TIGHT} AS r FROM {{rows}}")
def x3(df):
    return df.select("t", textnorm.tighten_punctuation(F.col("t")).alias("r"))


TYPOS = [("teh cat teh",), ("hte teh",), ("none",)]


@fixed("x6_replace_typos", TYPOS, "t VARCHAR", "SELECT t, replace(replace(t, 'hte', 'teh'), 'teh', 'the') AS r FROM {rows}")
def x6(df):
    return df.select("t", textnorm.replace_typos(F.col("t"), [("hte", "teh"), ("teh", "the")]).alias("r"))


HINDI = [("प्रशन्न: क्या\nहै",), ("एक\nउत्तर: दो",), ("उत्त: हाँ",), ("कुछ नहीं",)]


@fixed("x7_hindi_dialogue", HINDI, "t VARCHAR", "SELECT t, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, 'प्रश[्न]*:', 'प्रश्न:', 'g'), 'उत्त[र]*:', 'उत्तर:', 'g'), chr(10) || 'प्रश्न:', chr(1)), chr(10) || 'उत्तर:', chr(2)), chr(10), ' '), chr(1), chr(10) || 'प्रश्न:'), chr(2), chr(10) || 'उत्तर:') AS r FROM {rows}")
def x7(df):
    return df.select("t", textnorm.repair_dialogue(F.col("t"), "hi").alias("r"))


GUJARATI = [("મુમુxષુy: હા\nના",), ("એક\nઉત્તર: બે",), ("સાદું",)]


@fixed("x8_gujarati_dialogue", GUJARATI, "t VARCHAR", "SELECT t, replace(replace(replace(regexp_replace(t, 'મુમુ[^:]*ષુ[^:]*:', 'મુમુક્ષુ:', 'g'), chr(10) || 'ઉત્તર:', chr(1)), chr(10), ' '), chr(1), chr(10) || 'ઉત્તર:') AS r FROM {rows}")
def x8(df):
    return df.select("t", textnorm.repair_dialogue(F.col("t"), "gu").alias("r"))


CHAIN = [("  ( एक ) दो|  तीन ..  ",), (None,), ("a  b , c",), ("\n\n",)]


@fixed(
    "x9_normalize_chain", CHAIN, "t VARCHAR",
    "SELECT t, trim(regexp_replace(replace(" + TIGHT.replace("(t,", "(u,") + ", chr(10), ' '), '\\s+', ' ', 'g')) AS r FROM (SELECT t, translate(replace(replace(replace(coalesce(t, ''), chr(160), ' '), chr(8201), ' '), chr(8239), ' '), '|Il1॥', '।।।।।') AS u FROM {rows})",
)
def x9(df):
    return df.select("t", textnorm.normalize(F.col("t"), "hi").alias("r"))


MARKDOWN = [("Test with​special characters﻿",), ("  a   b\nc  ",), (" x",)]


@fixed("x10_clean_markdown", MARKDOWN, "t VARCHAR", "SELECT t, trim(regexp_replace(replace(replace(replace(replace(replace(t, chr(160), ' '), chr(8201), ' '), chr(8239), ' '), chr(8203), ''), chr(65279), ''), ' +', ' ', 'g')) AS r FROM {rows}")
def x10(df):
    return df.select("t", textnorm.clean_markdown(F.col("t")).alias("r"))


HEADERS = [("Page 12 Chapter one text",), ("text Page 3 Page 4",), ("no header",)]


@fixed("x11_strip_headers", HEADERS, "t VARCHAR", r"SELECT t, CASE WHEN regexp_matches(u, 'Chapter \w+') THEN trim(regexp_replace(u, 'Chapter \w+', '')) ELSE u END AS r FROM (SELECT t, CASE WHEN regexp_matches(t, 'Page \d+') THEN trim(regexp_replace(t, 'Page \d+', '')) ELSE t END AS u FROM {rows})")
def x11(df):
    return df.select("t", textnorm.strip_headers(F.col("t"), [r"Page \d+", r"Chapter \w+"]).alias("r"))


NASAL = [("अन्त सन्न गण्डक",), ("चम्पा कम्बल सम्मान",), ("पङ्क पञ्च हिन्दी",), ("अमर",)]
HI_FOLD = "regexp_replace({}, 'न्([तथदधनसशहयवलरचछजझकखगघ])|ण्([टठडढण])|म्([पफबभम])|ङ्([कखगघ])|ञ्([चछजझ])', 'ं\\1\\2\\3\\4\\5', 'g')"
GU_FOLD = "regexp_replace({}, 'ન્([તથદધનસશચજઝકખગઘ])|મ્([પફબભમ])|ણ્([ટઠડઢણ])', 'ં\\1\\2\\3', 'g')"


@fixed("x12_fold_nasals_hindi", NASAL, "t VARCHAR", f"SELECT t, {HI_FOLD.format('t')} AS r FROM {{rows}}")
def x12(df):
    return df.select("t", textnorm.fold_nasals(F.col("t"), "hi").alias("r"))


NASAL_GU = [("અન્ત સમ્માન",), ("ખણ્ડ પન્ના",), ("न्छ અમર",)]


@fixed("x12_fold_nasals_gujarati", NASAL_GU, "t VARCHAR", f"SELECT t, {GU_FOLD.format('t')} AS r, {GU_FOLD.format(chr(39).join(['replace(t, ', 'न्छ', ', ', 'ंछ', ')']))} AS strict FROM {{rows}}")
def x12b(df):
    return df.select("t", textnorm.fold_nasals(F.col("t"), "gu").alias("r"), textnorm.fold_nasals_strict_gu(F.col("t")).alias("strict"))


@fixed("x12_fold_nasals_mixed", NASAL + NASAL_GU, "t VARCHAR", f"SELECT t, {GU_FOLD.format(HI_FOLD.format('t'))} AS r FROM {{rows}}")
def x12c(df):
    return df.select("t", textnorm.fold_nasals_mixed(F.col("t")).alias("r"))


FOLD = [("STRASSE",), ("ﬁne Ⅷ",), ("ABC१२",), (None,)]


@fixed("x13_compatibility_casefold", FOLD, "t VARCHAR", "")
def x13(df):
    return df.select("t", textnorm.nfkc_casefold(F.col("t")).alias("r"))


@C.query("x13_lower", "SELECT doc_id, lower(text) AS t FROM documents")
def x13b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))


WORDS = [("यह कौन था और क्या है",), ("राम के साथ",), ("અને આ છે",), ("the end",)]


@fixed("x15_stop_words", WORDS, "t VARCHAR", r"SELECT t, i - 1 AS position, w AS token FROM (SELECT t, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT t, regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}]+') AS l FROM {rows})) WHERE w NOT IN (" + ", ".join(f"'{w}'" for w in textnorm.STOP_WORDS) + ")")
def x15(df):
    return df.select("t", F.explode(textnorm.without_stop_words(textnorm.tokens(F.col("t")))).alias("p")).select("t", F.col("p.position").cast("long").alias("position"), "p.token")


@C.query("x19_is_english", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.7 * length(regexp_replace(text, '\s', '', 'g')) AS english FROM documents")
def x19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textnorm.is_english(F.col("text")).alias("english"))


VERSES = [("Gatha 15",), ("shlok 1-6",), ("KALASH 12 extra",), ("Prose heading",), ("Gatha",)]


@fixed("x20_verse_heading", VERSES, "t VARCHAR", r"SELECT t, CASE WHEN m THEN upper(k[1]) || lower(substr(k, 2)) END AS type, CASE WHEN m THEN CAST(a AS INTEGER) END AS start_num, CASE WHEN m THEN CAST(coalesce(nullif(b, ''), a) AS INTEGER) END AS end_num FROM (SELECT t, regexp_matches(t, p) AS m, regexp_extract(t, p, 1) AS k, nullif(regexp_extract(t, p, 2), '') AS a, regexp_extract(t, p, 3) AS b FROM (SELECT t, '(?i)^(Shlok|Gatha|Kalash|Sutra|Chhand)\s+(\d+)(?:-(\d+))?' AS p FROM {rows}))")
def x20(df):
    return df.select("t", scalars.verse_heading(F.col("t")).alias("v")).select("t", "v.type", "v.start_num", "v.end_num")


PAGES = [("Page Number - 12",), ("page number 7",), ("Page 3",), ("Page Number -5",)]


@fixed("x21_page_heading", PAGES, "t VARCHAR", r"SELECT t, TRY_CAST(nullif(regexp_extract(t, '(?i)^Page\s+Number\s*-?\s*(\d+)$', 1), '') AS INTEGER) AS page FROM {rows}")
def x21(df):
    return df.select("t", scalars.page_heading(F.col("t")).alias("page"))


@fixed("x22_section_names", [("Teeka",), ("Page Number 3",), ("Translation",)], "t VARCHAR", "SELECT t, t AS name FROM {rows}")
def x22(df):
    return df.select("t", scalars.checked_section(F.col("t")).alias("name"))


NAMES = [("Hindi",), ("gujarati",), ("sa",), ("xx",)]


@fixed("x23_x37_languages", NAMES, "t VARCHAR", "SELECT t, c AS code, CASE c WHEN 'hi' THEN 'text_content_hindi' WHEN 'gu' THEN 'text_content_gujarati' WHEN 'sa' THEN 'text_content_sanskrit' ELSE 'text_content_hindi' END AS field FROM (SELECT t, CASE lower(t) WHEN 'hindi' THEN 'hi' WHEN 'gujarati' THEN 'gu' ELSE t END AS c FROM {rows})")
def x23(df):
    code = scalars.language_code(F.col("t"))
    return df.select("t", code.alias("code"), scalars.text_field(code).alias("field"))


DATES = [("23-10-1985",), ("31-02-1985",), ("1985-10-23",), ("soon",), (None,)]


@fixed("x24_dates", DATES, "t VARCHAR", "SELECT t, CAST(try_strptime(t, '%d-%m-%Y') AS DATE) AS chunk, coalesce(strftime(try_strptime(t, '%d-%m-%Y'), '%Y-%m-%d'), t) AS metadata FROM {rows}")
def x24(df):
    return df.select("t", scalars.chunk_date(F.col("t")).alias("chunk"), scalars.metadata_date(F.col("t")).alias("metadata"))


@fixed("x25_x26_years", [("in 1975 and 1980",), ("none",), ("2001-02-03",)], "t VARCHAR", r"SELECT t, y AS year, make_date(y, 1, 1) AS first, make_date(y, 12, 31) AS last FROM (SELECT t, TRY_CAST(nullif(regexp_extract(t, '(\d{4})', 1), '') AS INTEGER) AS y FROM {rows})")
def x25(df):
    year = scalars.first_year(F.col("t"))
    return df.select("t", year.alias("year"), scalars.year_bounds(year, year).alias("b")).select("t", "year", "b.first", "b.last")


@C.query("x27_checksums", "SELECT doc_id, sha256(text) AS sha, substr(sha256(source), 1, 16) AS short, sha256(source || ':' || '1,3') AS pages FROM documents")
def x27(spark, sf):
    pages = scalars.pages_checksum(F.col("source"), F.array(F.lit(3), F.lit(0), F.lit(1)))
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("source", 256), 1, 16).alias("short"), pages.alias("pages"))


@fixed("x27_uuid5", [("hindi/cities/a.pdf",), ("पुस्तक/एक.md",)], "t VARCHAR", "")
def x27b(df):
    return df.select("t", scalars.uuid5_url(F.col("t")).alias("id"))


@C.query("x28_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x28(spark, sf):
    parsed = F.from_json("props", "struct<k:bigint>")
    again = F.from_json(F.to_json(parsed), "struct<k:bigint>")
    return table(spark, sf, "events").select("event_id", again["k"].alias("k"))


REPLIES = [('```json\n[{"index": 0, "pravachan_no": "12", "date": "N/A"}]\n```',), ('{"results": [{"index": 1, "pravachan_no": "N/A", "date": "01-02-1980"}]}',), ('{"index": 2, "pravachan_no": "5", "date": null}',), ('{"0": {"pravachan_no": "7", "date": "03-04-1990"}}',)]


@fixed("x29_model_replies", REPLIES, "t VARCHAR", "")
def x29(df):
    from granary.operators.models import reply_to_rows

    return df.select(F.explode(reply_to_rows(F.col("t"))).alias("r")).select("r.index", "r.pravachan_no", "r.date")


@C.query("x30_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS p FROM embeddings")
def x30(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalars.sigmoid(F.col("embedding")[0].cast("double")), 6).alias("p"))


@C.query("x33_basename", r"SELECT page_id, string_split(url, '/')[-1] AS name, array_to_string(string_split(url, '/')[-2:], '/') AS display FROM pages")
def x33(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.basename(F.col("url")).alias("name"), scalars.display_path(F.col("url")).alias("display"))


@fixed("x34_log_escape", [('a,b "c"\nd\r',), ("plain",)], "t VARCHAR", "SELECT t, replace(replace(replace(replace(t, ',', ';'), '\"', ''''), chr(10), ' '), chr(13), '') AS r FROM {rows}")
def x34(df):
    return df.select("t", scalars.log_escape(F.col("t")).alias("r"))


@fixed("x35_elapsed", [(5.04,), (78.0,), (7200.0,), (59.95,)], "s DOUBLE", "SELECT s, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS r FROM {rows}")
def x35(df):
    return df.select("s", scalars.elapsed(F.col("s")).alias("r"))


@fixed("x36_english_suffix", [("यह kaun", 7), ("abc def", 3), ("a1b", 3), ("कौन", 3)], "t VARCHAR, cursor_at INTEGER", "SELECT t, cursor_at, regexp_extract(substr(t, 1, cursor_at), '([A-Za-z]+)$', 1) AS r FROM {rows}")
def x36(df):
    return df.select("t", "cursor_at", scalars.english_suffix(F.col("t"), F.col("cursor_at")).alias("r"))


@fixed("a18_cost", [(100, "cloud"), (7, "local")], "pages INTEGER, engine VARCHAR", "SELECT pages, engine, printf('%.2f', CASE WHEN engine = 'cloud' THEN pages * 0.13::DOUBLE ELSE 0.0::DOUBLE END) AS cost FROM {rows}")
def a18(df):
    return df.select("pages", "engine", scalars.cost(F.col("pages"), F.col("engine")).alias("cost"))


IPS = [("10.0.0.1",), ("172.16.5.5",), ("172.32.0.1",), ("192.168.1.1",), ("8.8.8.8",), ("a.b.c.d",), ("1.2.3",), ("localhost",), (None,)]


@fixed("f21_private_ip", IPS, "ip VARCHAR", "SELECT ip, coalesce(ip IN ('localhost', '127.0.0.1', '::1', 'unknown') OR len(p) <> 4 OR len(list_filter(p, lambda x: TRY_CAST(x AS INTEGER) IS NULL)) > 0 OR p[1] = '10' OR (p[1] = '172' AND TRY_CAST(p[2] AS INTEGER) BETWEEN 16 AND 31) OR (p[1] = '192' AND p[2] = '168'), TRUE) AS own FROM (SELECT ip, string_split(ip, '.') AS p FROM {rows})")
def f21(df):
    return df.select("ip", scalars.is_private_ip(F.col("ip")).alias("own"))


HEADS = [("पृष्ठ 123 भाग", 0), ("12/34", 2), ("a long paragraph that is not a header at all", 0), ("Chapter", 1), ("", 0)]


@fixed("f15_running_heads", HEADS, "t VARCHAR, n INTEGER", "SELECT t, n, (n = 0 AND length(t) < 35 AND d > 2) OR (length(t) > 0 AND length(t) < 20 AND d >= 0.3 * length(t)) OR regexp_matches(t, '^Chap') AS head FROM (SELECT *, len(regexp_extract_all(t, '[0-9०-९]')) AS d FROM {rows})")
def f15(df):
    return df.select("t", "n", textnorm.is_running_head(F.col("t"), F.col("n"), ["^Chap"]).alias("head"))


LINES = [("* * *", True), ("Chapter 1", False), ("long centered line of text", True)]


@fixed("f16_header_lines", LINES, "t VARCHAR, centered BOOLEAN", "SELECT t, centered, (centered AND length(trim(t)) <= 10) OR regexp_matches(t, '^Chap') AS head FROM {rows}")
def f16(df):
    return df.select("t", "centered", textnorm.is_header_line(F.col("t"), F.col("centered"), ["^Chap"]).alias("head"))


@C.query("f17_blank_paragraphs", "SELECT doc_id, i - 1 AS position, trim(p) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> ''")
def f17(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "p"))
    return rows.withColumn("text", textnorm.strip(F.col("p"))).where("text <> ''").select("doc_id", F.col("position").cast("long").alias("position"), "text")


@C.query("f20_small_paragraphs", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 20 OR length(text) < 150")
def f20(spark, sf):
    return table(spark, sf, "documents").where(logs.small(F.col("text"), 20, 150)).select("doc_id")


@C.query("f25_contains_ignoring_case", "SELECT p_partkey FROM part WHERE contains(lower(p_type), lower('STEEL')) OR contains(lower(p_name), lower('Al'))")
def f25(spark, sf):
    has = lambda c, x: F.contains(F.lower(c), F.lower(F.lit(x)))
    return table(spark, sf, "part").where(has("p_type", "STEEL") | has("p_name", "Al")).select("p_partkey")


@fixed("f26_valid_pages", [("a", "3,0,-1,2"), ("b", ""), ("c", "x,5")], "k VARCHAR, pages VARCHAR", "SELECT k, array_to_string(list_sort(list_filter(list_transform(string_split(pages, ','), lambda p: TRY_CAST(p AS INTEGER)), lambda p: p > 0)), ',') AS valid FROM {rows}")
def f26(df):
    pages = F.transform(F.split("pages", ","), lambda p: p.try_cast("int"))
    return df.select("k", F.array_join(F.transform(F.array_sort(F.filter(pages, lambda p: p > 0)), lambda p: p.cast("string")), ",").alias("valid"))


@C.query("a12_length_histogram", "WITH b AS (SELECT CASE WHEN n <= 30 THEN 0 WHEN n <= 100 THEN 1 WHEN n <= 200 THEN 2 WHEN n <= 500 THEN 3 WHEN n <= 1000 THEN 4 WHEN n <= 1500 THEN 5 WHEN n <= 2000 THEN 6 WHEN n <= 5000 THEN 7 ELSE 8 END AS bucket FROM (SELECT length(unnest(string_split(text, chr(10)))) AS n FROM documents)) SELECT bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM b GROUP BY bucket")
def a12(spark, sf):
    rows = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("p"))
    return facets.histogram(rows, F.length("p"), [30, 100, 200, 500, 1000, 1500, 2000, 5000])


@C.query("p14_truncated_fields", "SELECT doc_id, left(text, 40) AS text, left(source, 3) AS source FROM documents")
def p14(spark, sf):
    cut = F.struct("doc_id", "text", "source").alias("r")
    return table(spark, sf, "documents").select(cut).select(F.col("r").withField("text", F.left("r.text", F.lit(40))).withField("source", F.left("r.source", F.lit(3))).alias("r")).select("r.*")


@C.query("p17_request_payload", "SELECT c.key, list_sort(list(c.value)) AS vals FROM (SELECT lang AS key, source AS value FROM documents GROUP BY ALL) c GROUP BY c.key")
def p17(spark, sf):
    pairs = table(spark, sf, "documents").select(F.col("lang").alias("key"), F.col("source").alias("value")).distinct()
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("vals"))


@fixed("p17_excluded_words", [("a, b,,c ",), ("",), (" x",)], "t VARCHAR", "SELECT t, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS words FROM {rows}")
def p17b(df):
    return df.select("t", F.filter(F.transform(F.split("t", ","), lambda x: F.trim(x)), lambda x: x != "").alias("words"))


QA = [("प्रश्न: क्या?",), ("उत्तर : हाँ",), ("सादा",)]


@fixed("v7_language_rules", QA, "t VARCHAR", "SELECT t, starts_with(t, 'प्रश्न:') OR starts_with(t, 'प्रश्न :') OR starts_with(t, 'उत्तर:') OR starts_with(t, 'उत्तर :') AS opens, starts_with(t, 'उत्तर:') OR starts_with(t, 'उत्तर :') AS answers FROM {rows}")
def v7(df):
    return df.select("t", starts_with(F.col("t"), textnorm.STOP_PREFIXES["hi"]).alias("opens"), starts_with(F.col("t"), textnorm.ANSWER_PREFIXES["hi"]).alias("answers"))
