import os

import pytest

from tests.llm.rows import odd_rows

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use inside
    "did long, rid long, th string, key string, src int, first boolean, rank int, position double, "
    "bucket int, tail int, spans string, a int, b int, class string, keep boolean, ids string, hashes string"
)
N_EXTRA = 17


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(os.path.join(sf, "documents.parquet"))


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd(spark):
    rows = []
    for i, (doc_id, text) in enumerate(odd_rows()):
        source = None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 4}"
        rows.append((doc_id, text, None if i % 5 == 0 else "en", source, len(text or ""), *[None] * N_EXTRA))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
