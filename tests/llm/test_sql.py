"""The package's queries against their SQL, and their registration."""

import pytest
from compare import same
from llm_help import DATA

import corpus_pipeline
from granary.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    assert same(registry.queries()[name](spark, DATA), duck.sql(SQL[name])) > 0


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
