import json
import uuid

from pyspark.sql import functions as F

from granary.functions import scalars, textnorm
from granary.operators import books, index, neighbours, paragraphs, scans, search, state, suggest
from granary.plans import service
from granary.sources import files
from granary.streaming import ingest


def test_page_readers(spark, tmp_path):
    doc = tmp_path / "doc"
    doc.mkdir()
    (doc / "page_0001.txt").write_text("एक\n----\n  \n----\nदो ", encoding="utf-8")
    (doc / "page_0002.json").write_text(json.dumps({"page_num": 2, "metadata": {"prose_left_margin": 5.0}, "lines": [{"line_num": 1, "text": "x", "x_start": 1, "x_end": 9}]}))
    (doc / "page_0003.json").write_text("{}")
    (doc / "page_0004.json").write_text("not json")
    texts = files.read_page_texts(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.document_id, r.page_num, r.position, r.text) for r in texts] == [("doc", 1, 0, "एक"), ("doc", 1, 2, "दो")]
    pages = {r.page_num: r for r in files.read_page_json(spark, str(tmp_path)).collect()}
    assert pages[2].prose_left_margin == 5.0 and len(pages[2].lines) == 1
    assert pages[3].lines == [] and pages[4].avg_left_margin == 0.0
    assert files.page_lines(files.read_page_json(spark, str(tmp_path))).count() == 1


def test_page_writer(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 1, "b"), ("d", 1, 0, "a"), ("d", 2, 0, "c")], "document_id string, page_num int, position int, text string")
    files.write_pages(rows, str(tmp_path / "out"))
    back = {r.file: r.value for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back == {"page_0001.txt": "a\n----\nb", "page_0002.txt": "c"}


def test_listing_and_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# h")
    (tmp_path / "b.PDF").write_text("x")
    assert files.read_markdown(spark, str(tmp_path)).first().markdown == "# h"
    assert files.pdf_files(files.list_files(spark, str(tmp_path))).count() == 1


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    files.write_snapshot({"t": df}, str(tmp_path), "s1")
    files.write_snapshot({"t": df.union(df)}, str(tmp_path), "s2")
    assert files.list_snapshots(spark, str(tmp_path)) == ["s1", "s2"]
    assert files.restore_snapshot(spark, str(tmp_path))["t"].count() == 6
    assert files.restore_snapshot(spark, str(tmp_path), "s1")["t"].count() == 3
    assert files.list_snapshots(spark, str(tmp_path / "none")) == []


def test_tables(spark, tmp_path):
    files.ensure_table(spark, "granary_t", "a int", str(tmp_path / "t"))
    files.ensure_table(spark, "granary_t", "a int", str(tmp_path / "t"))
    assert spark.table("granary_t").count() == 0
    files.drop_tables(spark, ["granary_t", "granary_none"])
    assert not spark.catalog.tableExists("granary_t")


def test_csv_sink(spark, tmp_path):
    spark.createDataFrame([("a;b", 1)], "q string, n int").write.option("header", True).csv(str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().q == "a;b"


def test_settings_text():
    assert files.substitute_env("x: {HOST}:{PORT}", {"HOST": "h"}) == "x: h:{PORT}"


def test_uuid5_is_the_standard_one(spark):
    paths = ["hindi/a.pdf", "पुस्तक/एक.md", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalars.uuid5_url(F.col("p")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.p)) for r in got)


def test_digit_one_is_a_danda_before_digits_are_counted(spark):
    row = spark.createDataFrame([("पृष्ठ 111",)], "t string").select(textnorm.is_running_head(textnorm.repair_dandas(F.col("t")), F.lit(0), []).alias("a"), textnorm.is_running_head(F.col("t"), F.lit(0), []).alias("b")).first()
    assert not row.a and row.b


def test_dialogue_grammar():
    q, a = ("Q:",), ("A:",)
    items = [("Q:1", 1), ("A:1", 1), ("Q:2", 1), ("A:2", 2), ("text", 2), ("A:3", 2), ("Q:3", 3)]
    assert paragraphs.merge_dialogue(items, q, a) == [("Q:1\nA:1\nQ:2\nA:2", 1), ("text", 2), ("A:3", 2), ("Q:3", 3)]


def test_typed_merging():
    items = [("PROSE", "a", 1), ("QA", "q", 1), ("QA", "r", 1), ("PROSE", "b।", 2), ("VERSE", "v", 2), ("VERSE", "w", 2), ("PROSE", "c", 3), ("PROSE", "d।", 3)]
    assert paragraphs.merge_typed(items, ("।",)) == [("PROSE", "a", 1), ("QA", "q\nr b।", 1), ("VERSE", "v\nw", 2), ("PROSE", "c d।", 3)]


def test_dialogue_plan_equals_the_grammar(spark):
    """Random items against the rule, word for word: a block, then answers, each with the opener right after it."""
    import random

    rng, rows, want = random.Random(4), [], []
    stops, answers = ["Q:", "A:"], ["A:"]
    for d in range(40):
        items = [(f"{rng.choice(['Q:', 'A:', 'T '])}{k}", k // 3) for k in range(rng.randrange(1, 25))]
        rows += [(str(d), p, k, t) for k, (t, p) in enumerate(items)]
        queue, n = list(items), 0
        while queue:
            block = [queue.pop(0)]
            if block[0][0].startswith(tuple(stops)):
                while queue and queue[0][0].startswith("A:"):
                    block.append(queue.pop(0))
                    block += [queue.pop(0)] if queue and queue[0][0].startswith(tuple(stops)) else []
            want.append((str(d), block[0][1], n, "PROSE" if block[0][0].startswith("T") else "QA", "\n".join(t for t, _ in block)))
            n += 1
        assert [t for t, _ in paragraphs.merge_dialogue(items, tuple(stops), tuple(answers))] == [w[4] for w in want if w[0] == str(d)]
    frame = spark.createDataFrame(rows, "document_id string, page int, position int, text string")
    got = paragraphs.dialogue_blocks(frame, stops=stops, answers=answers)
    assert sorted(map(tuple, got.select("document_id", "page", "position", "type", "text").collect())) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_typed_plan_equals_the_rule(spark):
    import random

    rng, rows, want = random.Random(5), [], []
    for d in range(40):
        items = [(rng.choice(["PROSE", "PROSE", "QA", "VERSE"]), f"t{k}{rng.choice(['', '', '।'])}", k // 4) for k in range(rng.randrange(1, 25))]
        rows += [(str(d), p, k, t, x) for k, (t, x, p) in enumerate(items)]
        found = paragraphs.merge_typed(items, ("।",))
        want += [(str(d), p, n, t, x) for n, (t, x, p) in enumerate(found)]
        runs = []
        for t, x, _ in items:
            if runs and t != "PROSE" and runs[-1][0] == t:
                runs[-1][1].append(x)
            else:
                runs.append((t, [x]))
        texts, open_ = [], None
        for t, xs in runs:
            x = "\n".join(xs)
            if open_ and (t == "PROSE" or t == open_ == "QA"):
                texts[-1] += " " + x
            else:
                texts.append(x)
                open_ = t
            open_ = None if t == "VERSE" or x.endswith("।") else open_
        assert [x for _, x, _ in found] == texts
    frame = spark.createDataFrame(rows, "document_id string, page int, position int, type string, text string")
    got = paragraphs.document_paragraphs(frame, "hi")
    assert sorted(map(tuple, got.select("document_id", "page", "position", "type", "text").collect())) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_incremental_ingestion(spark, tmp_path):
    src, seen = tmp_path / "in", []
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "document_id string, checksum string").write.parquet(str(src))
    run = lambda: ingest.ingest(ingest.new_files(spark, str(src), "document_id string, checksum string"), ["document_id", "checksum"], lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"))
    run()
    assert sorted(r.document_id for r in seen) == ["a", "b"]
    spark.createDataFrame([("a", "2"), ("b", "1")], "document_id string, checksum string").write.mode("append").parquet(str(src))
    run()
    assert sorted((r.document_id, r.checksum) for r in seen) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_windows_over_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = ingest.counts_by_window(stream, "ts", "1 day", late="10 minutes")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_cached_view(spark):
    now, built = [0.0], []
    view = ingest.CachedView(lambda: built.append(1) or spark.range(1), 10, lambda: now[0])
    view.get(), view.get()
    now[0] = 11
    view.get()
    view.invalidate()
    view.get()
    assert len(built) == 3


def test_service(spark):
    rows = [("d_0", "d", 0, "Pravachan", "hi", "राम और सीता", [1.0, 0.0]), ("d_1", "d", 1, "Pravachan", "hi", "सीता राम राम", [0.6, 0.8]), ("e_0", "e", 0, "Granth", "hi", "राम कथा", [0.0, 1.0]), ("x", "x", None, "Granth", "gu", "રામ", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, para_ord int, category string, language string, text string, vector_embedding array<double>").cache()
    request = service.SearchRequest("राम", page_size=2)
    assert service.is_lexical(chunks, request) and not service.is_lexical(chunks, service.SearchRequest("राम कौन था?"))
    page, totals = service.lexical(chunks, request)
    assert totals.first().total_exact == 3 and page.count() == 2 and "<em>राम</em>" in page.first().snippet
    only, _ = service.lexical(chunks, service.SearchRequest("राम", content_type="Granth", exclude_words=("सीता",)))
    assert [r.chunk_id for r in only.collect()] == ["e_0"]
    exact, _ = service.lexical(chunks, service.SearchRequest("सीता राम", exact_match=True))
    assert [r.chunk_id for r in exact.collect()] == ["d_1"]
    assert [r.chunk_id for r in service.vector(chunks, request, [1.0, 0.0]).collect()] == ["d_0", "d_1"]
    second = service.SearchRequest("राम", page_size=2, page_number=2)
    assert service.vector(chunks, second, [1.0, 0.0]).count() == 0
    assert [r.chunk_id for r in service.vector(chunks, second, [1.0, 0.0], top=4).collect()] == ["e_0"]
    assert [r.chunk_id for r in service.similar(chunks, "d_0").collect()] == ["d_1", "e_0"]
    near = service.context(chunks, "d_1").first()
    assert near.previous_chunk_id == "d_0" and near.next_chunk_id is None
    assert service.context(chunks, "x").count() == 0
    vocabulary = spark.createDataFrame([("सराफा", 3), ("राम", 9)], "token string, df int")
    assert service.suggestions(chunks, vocabulary, "सराफ") == ["सराफा"]
    assert service.suggestions(chunks, vocabulary, "राम") == []


def test_state_roundtrip(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "k string, v string")
    assert sorted(map(tuple, state.upsert(old, new, "k").collect()), key=str) == [("a", "x"), ("b", None), ("c", "z")]
    assert sorted(map(tuple, state.update_keeping(old, new, "k", ["v"]).collect())) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_ingestion(spark):
    from granary.operators import models
    from granary.plans import ingestion

    words = ["यह पहली पंक्ति है", "और यह समाप्त होती है।", "12/34", "प्रश्न: क्या?", "उत्तर: हाँ।"]
    texts = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(words)] + [("d", 2, 0, "पृष्ठ दो।")], "document_id string, page_num int, position int, text string")
    paras = ingestion.generate(texts, "hi", "paragraph").cache()
    assert [(r.page, r.text) for r in paras.orderBy("position").collect()] == [(1, "यह पहली पंक्ति है और यह समाप्त होती है।"), (1, "प्रश्न: क्या?\nउत्तर: हाँ।"), (2, "पृष्ठ दो।")]
    files_ = spark.createDataFrame([("d", "d.pdf", "hi", {"category": "Pravachan"})], "document_id string, original_filename string, language string, metadata map<string,string>")
    pages = spark.createDataFrame([("d", 1, "248", "23-10-1985")], "document_id string, page int, pravachan_no string, date string")
    got = ingestion.chunks(paras, files_, pages, models.embed()).orderBy("para_ord").collect()
    assert [r.chunk_id for r in got] == ["d_p1_para0", "d_p1_para1", "d_p2_para2"]
    assert str(got[0].date) == "1985-10-23" and got[2].date is None and got[0].text_content_gujarati is None and len(got[0].vector_embedding) == 64


def test_lines_strategy(spark):
    from granary.plans import ingestion

    lines = [(1, "लंबी पंक्ति चलती है", 100, 900), (2, "और रुकती है।", 100, 400), (3, "Chapter 1", 100, 300), (4, "नई बात।", 130, 900)]
    df = spark.createDataFrame([("d", 1, n, t, a, b, 100.0, 900.0) for n, t, a, b in lines], "document_id string, page_num int, line_num int, text string, x_start int, x_end int, prose_left_margin double, prose_right_margin double")
    got = ingestion.generate(df, "hi", header_patterns=["^Chapter"]).orderBy("position").collect()
    assert [r.text for r in got] == ["लंबी पंक्ति चलती है और रुकती है।", "नई बात।"]


BOOK = """# अधिकार एक

## Gatha 1

मूल  श्लोक

### Translation

अनुवाद

### Teeka

पहली टीका

दूसरी टीका

### Page Number - 7

## Kalash 2-3

कलश पाठ

## प्रस्तावना

पहला पैरा

### उपखंड

उप पैरा एक

उप पैरा दो

### खाली

## Shlok 9

श्लोक
"""


def test_book_grammar():
    book = books.parse_book(BOOK)
    assert [(v["type"], v["seq_num"], v["type_start_num"], v["type_end_num"], v["page_num"]) for v in book["verses"]] == [("Gatha", 1, 1, 1, 7), ("Kalash", 2, 2, 3, None), ("Shlok", 5, 9, 9, None)]
    assert [v["verse"] for v in book["verses"]] == ["मूल श्लोक", "कलश पाठ", "श्लोक"]
    assert book["verses"][0]["teeka"] == ["पहली टीका", "दूसरी टीका"]
    (prose,) = book["prose_sections"]
    assert (prose["seq_num"], prose["heading"], prose["content"], prose["adhikar"]) == (3, "प्रस्तावना", ["पहला पैरा"], "अधिकार एक")
    assert [(u["seq_num"], u["heading"], u["content"]) for u in prose["subsections"]] == [(4, "उपखंड", ["उप पैरा एक", "उप पैरा दो"])]


def test_index_equals_scan(spark, sf, tmp_path):
    """Lookups read their own folders only, and repeated, unknown and no terms are as told."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    own = index.write(docs, "doc_id", "text", str(tmp_path / "ix"))
    rounded = lambda df: sorted((r[0], round(r[1], 6)) for r in df.collect())
    for terms in (["the"], ["the", "of"], ["the", "the"], ["nosuchterm", "the"]):
        assert rounded(index.score(own, terms)) == rounded(search.score(docs, "doc_id", "text", terms).select("doc_id", "score"))
    assert index.score(own, []).count() == 0
    plan = index.lookup(own.postings, ["the"])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "bucket" in filters.split("PushedFilters")[0] and "EqualTo(token,the)" in filters.split("PushedFilters")[1]


def test_drop_goes_on(spark):
    failed = files.drop_tables(spark, ["no such name", "granary_absent"])
    assert list(failed) == ["no such name"]


def test_eviction_by_eras(spark):
    rows = [(k, (k * 7) % 5 + 1) for k in range(60)]
    df = spark.createDataFrame(rows, "used long, size long")
    for needed in (0, 1, 40, 10**6):
        total, want = 0, []
        for used, size in rows:
            if total < needed:
                want.append(used)
            total += size
        got = neighbours.evict_oldest(df, "size", "used", needed, F.floor(F.col("used") / 7))
        assert sorted(r.used for r in got.collect()) == want


def test_similar_words_equal_all_pairs(spark):
    """Also words beyond the length up to which they are joined by their rests."""
    stem = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["house", "mouse", "horse", "hous", "houses", "haus", stem, stem[:-1], stem[:-3] + "zzz", stem[:24], stem[:23]]
    words = ["hoise", "housse", "hosue", stem + "x", stem[:10] + stem[11:], stem[:22] + "q", stem[:24] + "?", "house"]
    v = spark.createDataFrame([(w, 1) for w in vocabulary], "token string, df int")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {(r.word, r.option) for r in suggest.similar_words(w, v, n=99).collect()}
    pairs = w.crossJoin(v).where("substring(word, 1, 1) = substring(token, 1, 1) and levenshtein(word, token) between 1 and 2")  # a small fixture
    near = pairs.withColumn("s", 1 - F.levenshtein("word", "token") / F.least(F.length("word"), F.length("token"))).where("s >= 0.6")
    assert got == {(r.word, r.token) for r in near.collect() if r.word not in vocabulary}


def test_scans(spark):
    """Pages out of range are skipped, margins cut, blank paragraphs left out, and engines can be put in."""
    content = b"head\none\n\n \n\ntwo\nfoot\fsecond"
    df = spark.createDataFrame([("d", bytearray(content)), ("e", None), ("f", bytearray(b""))], "document_id string, content binary")
    rows = lambda **how: sorted((r.document_id, r.page_num, r.position, r.text) for r in scans.scanned_pages(df, **how).collect())
    assert rows() == [("d", 1, 0, "head\none"), ("d", 1, 1, "two\nfoot"), ("d", 2, 0, "second")]
    assert rows(pages=[2, 9, 0, 2]) == [("d", 2, 0, "second")]
    assert rows(pages=[1], crop_top=15, crop_bottom=15) == [("d", 1, 0, "one"), ("d", 1, 1, "two")]
    assert rows(pages=[2], recogniser=lambda image: image.decode().upper()) == [("d", 2, 0, "SECOND")]


def test_embedding_of_odd_texts(spark, tmp_path):
    import duckdb
    from compare import same

    from granary.plans import catalog

    # w14 and w22 stand at one place with opposite signs.
    texts = [None, "", " ", "　 ", "\n", "\t \r\n", " ", "w14 w22", "w22 w14 w22", "a word"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(catalog.queries()["v1_embedding"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["v1_embedding"]))


def test_rests_of_words_are_not_broadcast(spark):
    """Spark takes the rests of words to be as few as the words."""
    names = spark.range(1500).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS token", "1 AS df")
    words = names.selectExpr("concat(substring(token, 1, 9), 'x', substring(token, 11)) AS word")
    got = suggest.similar_words(words, names)
    assert got.count() == 3 * 1500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan


def test_a_book_of_many_sections(spark):
    """Time grows with the sections; chunks of both kinds come from one pass over the books."""
    import time

    verse = "## Gatha {0}\n\nमूल\n\n### Teeka\n\nपहली\n\nदूसरी\n\n### Page Number - {0}"
    prose = "## शीर्षक {0}\n\nपैरा\n\n### उपखंड\n\nनीचे"
    text = "# अधिकार\n\n" + "\n\n".join((verse if k % 2 else prose).format(k) for k in range(10_000))
    begun = time.process_time()
    book = books.parse_book(text)
    assert time.process_time() - begun < 5
    assert len(book["verses"]) == len(book["prose_sections"]) == 5000
    frame = spark.createDataFrame([("b", text)], "granth_id string, markdown string").select("granth_id", books.parse_books("markdown").alias("b")).select("granth_id", "b.*")
    chunks = books.book_chunks(frame)
    assert [chunks.where(f"embed = {e}").count() for e in ("true", "false")] == [20_000, 5000]
    assert chunks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    both = books.verse_chunks(frame).unionByName(books.prose_chunks(frame))
    assert chunks.exceptAll(both).count() == both.exceptAll(chunks).count() == 0
