"""Pages, paragraphs, books, models and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import books, models, paragraphs, scans
from granary.plans.base import Catalog, fixed_in, table, values

C = Catalog()
fixed = fixed_in(C)

# Recognised words and lines

WORDS = "(SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_suppkey % 3 AS INTEGER) AS page_num, CAST(l_linenumber AS INTEGER) AS word_num, CAST(l_partkey % 5 AS INTEGER) AS line_num, CAST(l_quantity AS INTEGER) AS left_, 20 AS width, l_discount * 1000 AS conf, l_returnflag AS text, l_extendedprice AS tie FROM lineitem)"


def _words(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), (F.col("l_suppkey") % 3).cast("int").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        (F.col("l_partkey") % 5).cast("int").alias("line_num"), F.col("l_linenumber").alias("word_num"), F.col("l_quantity").cast("int").alias("left"), F.lit(20).alias("width"),
        (F.col("l_discount") * 1000).alias("conf"), F.col("l_returnflag").alias("text"),
    )


LINES_SQL = f"(SELECT document_id, page_num, line_num, string_agg(text, ' ' ORDER BY word_num, text) AS text, min(left_) AS x_start, max(left_ + width) AS x_end FROM {WORDS} WHERE text IS NOT NULL AND conf > 10 GROUP BY ALL)"


@C.query("s5_f14_a1_words_to_lines", f"SELECT * FROM {LINES_SQL}")
def a1(spark, sf):
    return paragraphs.words_to_lines(_words(spark, sf)).drop("block_num", "par_num")


@C.query(
    "a2_page_margins",
    f"SELECT document_id, page_num, round(avg(x_start), 6) AS avg_left_margin, round(avg(x_end), 6) AS avg_right_margin, CASE WHEN count(*) < 4 THEN list_sort(list(x_start))[count(*) // 2 + 1]::DOUBLE ELSE (list_sort(list(x_start))[1] + list_sort(list(x_start))[2]) / 2.0::DOUBLE END AS prose_left_margin, CASE WHEN count(*) < 4 THEN list_sort(list(x_end))[count(*) // 2 + 1]::DOUBLE ELSE (list_sort(list(x_end))[-1] + list_sort(list(x_end))[-2]) / 2.0::DOUBLE END AS prose_right_margin FROM {LINES_SQL} GROUP BY ALL",
)
def a2(spark, sf):
    out = paragraphs.page_margins(paragraphs.words_to_lines(_words(spark, sf)))
    return out.select("document_id", "page_num", F.round("avg_left_margin", 6).alias("avg_left_margin"), F.round("avg_right_margin", 6).alias("avg_right_margin"), "prose_left_margin", "prose_right_margin")


@C.query("s3_s4_v6_scanned_pages", "SELECT doc_id::VARCHAR AS document_id, CAST(i AS INTEGER) AS page_num, trim(p) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> ''")
def s3(spark, sf):
    """Each line of a document stands for a scanned page; the plain engines are injected."""
    content = F.encode(F.translate("text", "\n", "\f"), "UTF-8")
    scans_of = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), content.alias("content"))
    return scans.scanned_pages(scans_of, recogniser=scans.plain_text, reader=scans.PlainDocument).select("document_id", "page_num", "text")


PAGE = [
    ("d", 1, 1, "शीर्षक", 300, 500), ("d", 1, 2, "पहली पंक्ति जो लंबी है और चलती है", 100, 900), ("d", 1, 3, "और समाप्त होती है।", 100, 400),
    ("d", 1, 4, "नया अनुच्छेद यहाँ से", 130, 900), ("d", 1, 5, "चलता रहता है", 100, 900), ("d", 1, 6, "यह एक मध्य में रखा छंद है", 250, 750),
    ("d", 1, 7, "उसकी दूसरी पंक्ति ।।१२।।", 250, 750), ("d", 1, 8, "प्रश्न: क्या है?", 100, 500), ("d", 1, 9, "उत्तर: यह है।", 100, 500), ("d", 1, 10, "  ", 100, 120),
    ("d", 2, 1, "पृष्ठ दो आगे चलता", 100, 900), ("d", 2, 2, "और रुकता है।", 100, 300),
]
PAGE_COLUMNS = "document_id VARCHAR, page_num INTEGER, line_num INTEGER, text VARCHAR, x_start INTEGER, x_end INTEGER"
QA = ["प्रश्न:", "उत्तर:"]


def _tagged(df):
    lines = df.withColumns({"prose_left_margin": F.lit(100.0), "prose_right_margin": F.lit(900.0)})
    return paragraphs.classify_lines(lines, "hi", [], QA)


@fixed(
    "w8_line_tags", PAGE, PAGE_COLUMNS,
    r"SELECT page_num, line_num, trim(text) = '' AS is_empty, x_start - 100 > 15 AND 900 - x_end > 20 AS is_centered, x_start - 100 > 15 AND NOT 900 - x_end > 20 AS is_indented, 900 - x_end > 15 AS is_ragged, trim(text) <> '' AND x_start - 100 > 15 AND 900 - x_end > 20 AND length(trim(text)) <= 10 AS is_header, starts_with(text, 'प्रश्न:') OR starts_with(text, 'उत्तर:') AS is_qa, regexp_matches(text, '(।|\?|!|\)|\]|\})$') AS ends_sentence, regexp_matches(text, '।।\p{Nd}+।।$') AS ends_verse FROM {rows}",
)
def w8a(df):
    return _tagged(df).select("page_num", "line_num", "is_empty", "is_centered", "is_indented", "is_ragged", "is_header", "is_qa", "ends_sentence", "ends_verse")


@fixed("w8_page_paragraphs", PAGE, PAGE_COLUMNS, "SELECT * FROM (VALUES (1, 0, 'PROSE', 'पहली पंक्ति जो लंबी है और चलती है और समाप्त होती है।'), (1, 1, 'PROSE', 'नया अनुच्छेद यहाँ से चलता रहता है'), (1, 2, 'VERSE', 'यह एक मध्य में रखा छंद है' || chr(10) || 'उसकी दूसरी पंक्ति ।।१२।।'), (1, 3, 'QA', 'प्रश्न: क्या है?'), (1, 4, 'QA', 'उत्तर: यह है।'), (2, 0, 'PROSE', 'पृष्ठ दो आगे चलता और रुकता है।')) t(page, position, type, text)")
def w8b(df):
    return paragraphs.page_paragraphs(_tagged(df)).select("page", "position", "type", "text")


@fixed("w4_w7_document_paragraphs", PAGE, PAGE_COLUMNS, "SELECT * FROM (VALUES (1, 0, 'PROSE', 'पहली पंक्ति जो लंबी है और चलती है और समाप्त होती है।'), (1, 1, 'PROSE', 'नया अनुच्छेद यहाँ से चलता रहता है'), (1, 2, 'VERSE', 'यह एक मध्य में रखा छंद है' || chr(10) || 'उसकी दूसरी पंक्ति ।।१२।।'), (1, 3, 'QA', 'प्रश्न: क्या है?' || chr(10) || 'उत्तर: यह है।'), (2, 4, 'PROSE', 'पृष्ठ दो आगे चलता और रुकता है।')) t(page, position, type, text)")
def w7(df):
    return paragraphs.document_paragraphs(paragraphs.page_paragraphs(_tagged(df)), "hi").select("page", "position", "type", "text")


@C.query("w6_dialogue_blocks")
def w6(spark, sf):
    """Users ask and assistants answer: one block per question with its answers."""
    text = F.concat(F.initcap("role"), F.lit(": "), "text")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.col("turn").cast("int").alias("position"), text.alias("text"))
    return paragraphs.dialogue_blocks(rows, stops=["User:"], answers=["Assistant:"])


# Books

#: A book per brand with a verse or a prose section per part, numbered through; empty subsections take no number.
SECTIONS = """(SELECT p_brand AS granth_id, p_partkey AS n, p_size AS p, p_size % 2 = 0 AS is_verse, p_partkey % 3 = 0 AS is_range,
CAST(1 + coalesce(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS seq FROM part)"""


def _books(spark, sf):
    n, p = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = lambda *parts: F.concat_ws("\n\n", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    put = lambda before, value: F.concat(F.lit(before), value)
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("## Kalash "), n, F.lit("-"), (F.col("p_partkey") + 1).cast("string"))).otherwise(put("## Gatha ", n))
    verse = lines(title, put("मूल  ", p), "### Translation", put("अनुवाद ", n), "### Teeka", put("पहली ", p), put("दूसरी ", n), put("### Page Number - ", p))
    prose = lines(put("## शीर्षक ", p), put("पैरा ", p), put("और ", n), put("### उपखंड ", n), put("नीचे ", p), "### खाली")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("granth_id"), "p_partkey", F.when(F.col("p_size") % 2 == 0, verse).otherwise(prose).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda r: r["text"]), "\n\n")
    markdown = rows.groupBy("granth_id").agg(F.concat(F.lit("# अधिकार "), "granth_id", F.lit("\n\n"), text).alias("markdown"))
    return markdown.select("granth_id", books.parse_books("markdown").alias("b")).select("granth_id", "b.*")


@C.query("s11_x38_w10_parse_book", f"SELECT granth_id, CASE WHEN is_range THEN 'Kalash' ELSE 'Gatha' END AS type, seq AS seq_num, CAST(n AS INTEGER) AS type_start_num, CAST(CASE WHEN is_range THEN n + 1 ELSE n END AS INTEGER) AS type_end_num, p AS page_num FROM {SECTIONS} WHERE is_verse")
def parse(spark, sf):
    return _books(spark, sf).select("granth_id", F.explode("verses").alias("v")).select("granth_id", "v.type", "v.seq_num", "v.type_start_num", "v.type_end_num", "v.page_num")


VERSE_CHUNKS = f"""(SELECT granth_id, granth_id || '_v' || seq || '_' || unnest(['verse', 'translation', 'teeka_0', 'teeka_1']) AS chunk_id, unnest(['मूल ' || p, 'अनुवाद ' || n, 'पहली ' || p, 'दूसरी ' || n]) AS text, unnest([FALSE, FALSE, TRUE, TRUE]) AS embed FROM {SECTIONS} WHERE is_verse)"""
PROSE_CHUNKS = f"""(SELECT granth_id, granth_id || '_p' || seq || unnest(['_content_0', '_content_1', '_sub' || (seq + 1) || '_content_0']) AS chunk_id, 'prose_' || unnest([seq || '_content_0', seq || '_content_1', (seq + 1) || '_content_0']) AS paragraph_id, unnest(['पैरा ' || p, 'और ' || n, 'नीचे ' || p]) AS text FROM {SECTIONS} WHERE NOT is_verse)"""


@C.query("p5_p6_verse_chunks", f"SELECT chunk_id, text, embed FROM {VERSE_CHUNKS}")
def p5(spark, sf):
    return books.verse_chunks(_books(spark, sf)).select("chunk_id", "text", "embed")


@C.query("p7_prose_chunks", f"SELECT chunk_id, paragraph_id, text FROM {PROSE_CHUNKS}")
def p7(spark, sf):
    return books.prose_chunks(_books(spark, sf)).select("chunk_id", "paragraph_id", "text")


@C.query("p8_renested_book", f"SELECT granth_id, count(*) FILTER (is_verse)::INTEGER AS n_verses, count(*) FILTER (NOT is_verse)::INTEGER AS n_prose, CASE WHEN bool_or(is_verse) THEN 'अधिकार ' || granth_id END AS adhikar FROM {SECTIONS} GROUP BY granth_id")
def p8(spark, sf):
    return _books(spark, sf).select("granth_id", F.size("verses").alias("n_verses"), F.size("prose_sections").alias("n_prose"), F.get("verses", F.lit(0))["adhikar"].alias("adhikar"))


@C.query("p9_verse_by_number", f"SELECT granth_id, max(CASE WHEN is_verse AND seq = 4 THEN 'मूल ' || p END) AS verse, NULL::VARCHAR AS none FROM {SECTIONS} GROUP BY granth_id")
def p9(spark, sf):
    verse = lambda k: books.verse_by_number(F.col("verses"), F.lit(k))["verse"]
    return _books(spark, sf).select("granth_id", verse(4).alias("verse"), verse(10**6).alias("none"))


@C.query("p10_prose_by_number", f"WITH s AS (SELECT granth_id, seq AS k, 'शीर्षक ' || p AS heading, NULL::INTEGER AS parent, NULL::VARCHAR AS parent_heading FROM {SECTIONS} WHERE NOT is_verse UNION ALL SELECT granth_id, seq + 1, 'उपखंड ' || n, seq, 'शीर्षक ' || p FROM {SECTIONS} WHERE NOT is_verse) SELECT b.granth_id, heading, parent, parent_heading FROM (SELECT DISTINCT p_brand AS granth_id FROM part) b LEFT JOIN s ON s.granth_id = b.granth_id AND k = 4")
def p10(spark, sf):
    found = books.prose_by_number(F.col("prose_sections"), F.lit(4))
    return _books(spark, sf).select("granth_id", found["heading"].alias("heading"), found["parent_seq_num"].alias("parent"), found["parent_heading"].alias("parent_heading"))


@C.query("u5_book_chunks", f"SELECT granth_id, count(*) AS n, count(*) FILTER (embed) AS embedded FROM (SELECT granth_id, embed FROM {VERSE_CHUNKS} UNION ALL SELECT granth_id, TRUE FROM {PROSE_CHUNKS}) GROUP BY granth_id")
def u5(spark, sf):
    return books.book_chunks(_books(spark, sf)).groupBy("granth_id").agg(F.count("*").alias("n"), F.count_if("embed").alias("embedded"))


@C.query("x38_page_elements", r"SELECT page_id, len(l) AS n, array_to_string(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), ' +', ' ', 'g'))), '|') AS texts FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1\b[^>]*>.*?</h1|h2\b[^>]*>.*?</h2|h3\b[^>]*>.*?</h3|p\b[^>]*>.*?</p)>') AS l FROM pages)")
def x38(spark, sf):
    found = books.html_elements(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda e: e["text"]), "|").alias("texts"))


@C.query("p4_chunk_assembly", "SELECT doc_id || '_p1_para' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS BIGINT) AS para_ord, CASE WHEN lang = 'fr' THEN NULL ELSE p END AS text_content_hindi, CASE WHEN lang = 'fr' THEN p END AS text_content_gujarati FROM (SELECT doc_id, lang, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))")
def p4(spark, sf):
    """French stands in for the second language."""
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(parts).alias("i", "p"))
    second = F.col("lang") == "fr"
    return rows.select(
        F.concat_ws("_", "doc_id", F.lit("p1"), F.concat(F.lit("para"), F.col("i"))).alias("chunk_id"), "doc_id", F.col("i").cast("long").alias("para_ord"),
        F.when(~second, F.col("p")).alias("text_content_hindi"), F.when(second, F.col("p")).alias("text_content_gujarati"),
    )


# Models


@C.query("v1_embedding", "SELECT doc_id, 64 AS dims, trim(text) <> '' AS unit FROM documents")
def v1(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", models.embed()("text").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    unit = F.when(F.col("text").isNotNull(), F.abs(square - 1) < 1e-5)
    return rows.select("doc_id", F.size("v").alias("dims"), unit.alias("unit"))


@C.query("v2_rerank", "WITH h AS (SELECT doc_id, regexp_split_to_array(lower(trim(substr(text, 1, 1000))), '\\s+') AS w FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25) SELECT doc_id, round((list_contains(w, 'the')::INTEGER + list_contains(w, 'of')::INTEGER) / 2.0::DOUBLE, 6) AS score FROM h")
def v2(spark, sf):
    hits = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25)
    return hits.select("doc_id", F.round(models.rerank_score(F.col("text"), "the of"), 6).alias("score"))


TITLES = [("d", 0, 1, "Talk No. 12 of 23-10-1985"), ("d", 1, 5, "Introduction"), ("e", 0, 2, "#A7 03-05-1986 evening")]


@fixed("v3_bookmark_reader", TITLES, "document_id VARCHAR, pos INTEGER, page INTEGER, title VARCHAR", r"SELECT document_id, pos, page, title, nullif(regexp_extract(title, '(?:No\.?|#)\s*(\w+)', 1), '') AS pravachan_no, nullif(regexp_extract(title, '\b(\d{2}-\d{2}-\d{4})\b', 1), '') AS date FROM {rows}")
def v3(df):
    return models.read_bookmarks(df)


VARIANTS = [("ram", "hi", 1, "राम"), ("ram", "hi", 2, "रम"), ("ram", "gu", 1, "રામ"), ("ram", "hi", 12, "रैम")]


@fixed("v4_transliteration", VARIANTS, "word VARCHAR, lang VARCHAR, rank INTEGER, variant VARCHAR", "SELECT word, lang, rank, variant FROM {rows} WHERE lang = 'hi' AND rank <= 10")
def v4(df):
    words = df.sparkSession.createDataFrame([("ram", "hi"), ("zzz", "hi")], "word string, lang string")
    return models.transliterate(words, df)


@C.query("a17_line_differences")
def a17(spark, sf):
    """Changed lines between two versions of a text."""
    from granary.operators.state import line_differences

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", line_differences("text", F.replace("text", F.lit(" la "), F.lit(" LA "))).alias("n_changed"))
