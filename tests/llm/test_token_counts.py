from collections import Counter

import pytest
from tests.llm.fixtures import documents, empty

from quillspark.llm import tokens
from quillspark.llm.token_counts import token_counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("tier", [dict(), dict(max_frequent=3, max_cached=5)])
def test_counts_equal_the_library(spark, name, tier):
    docs = documents(spark)
    path = tokens.default_path(name)
    lib = tokens.Library(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "")), n > 20) for r in docs.collect())
    got = Counter(tuple(r) for r in token_counts(docs, path=path, limit=20, **tier).collect())
    assert got == want


def test_empty_table(spark):
    assert token_counts(empty(spark)).collect() == []
