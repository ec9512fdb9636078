import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with every odd case: nulls, empties, copies, repeated rows, very long texts."""
    words = "the quick brown fox jumps over the lazy dog and runs to the river with a friend that is not as fast".split()
    base = " ".join(f"{w}{k}" for k, w in enumerate(words * 4))
    near = base.replace("fox3", "cat3")
    other = " ".join(f"{w}x{k * k}" for k, w in enumerate(words * 3))
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return [
        (1, base, "en"), (2, base, None), (3, near, "en"), (4, other, "fr"), (5, None, "en"), (6, "", "en"), (7, "   \n ", "en"), (8, "few words here", "de"),
        (9, "few words here", "de"), (10, long, "en"), (None, base + " tail", "en"), (11, other, "fr"), (11, other, "fr"), (12, "a" * 5000, "es"),
    ]


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """With further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs_rows, "doc_id long, text string, lang string")
    clash = {c: F.lit("x") for c in ("n_words", "kept", "component_id", "n", "m", "node", "block", "bucket", "words", "word", "digest", "value", "label", "key", "place", "n_tokens", "numbers")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
