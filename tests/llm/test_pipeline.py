import sentencepiece
from llm_help import DATA, shingle_set
from public_tokenizers import path
from test_duplicates import brute_leaks, classes, dropped
from test_rules_and_chats import expected

import corpus_pipeline
from granary.llm.quality import judge


def brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in judge(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if verdict[r.doc_id]]
    assert not any(expected(t)[-1] for _, t in rows)
    gone = dropped(rows)
    cut = []
    for d, (i, t) in enumerate(rows):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
        if not gone[d] or left.split():
            cut.append((i, left))
    reach = classes({i: shingle_set(t) for i, t in cut})
    single = [(i, t) for i, t in cut if reach[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks(single, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    return sorted((i, sp.encode(t)) for i, t in single if i not in leaked)


def test_pipeline_against_brute_force(spark):
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == brute_force(spark, DATA)


def test_stages_keep_the_columns_and_stand_odd_rows(spark, docs, no_docs):
    for frame in (docs, no_docs):
        now = frame
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == frame.columns, name
                now = corpus_pipeline.Scratch(spark).table(out, name)
        assert out.columns == ["doc_id", "n_tokens", "ids"]
        assert {r.doc_id for r in out.collect()} <= {1, 4, 11, 12, None}
