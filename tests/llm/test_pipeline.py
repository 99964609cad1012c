import hashlib

from tests.llm.fixtures import SCHEMA
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_quality import brute as base
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import brute as groups

import corpus_pipeline
from quillspark.llm import secrets, tokens


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = [[*r[:4], len(r[1])] for r in rows]
    docs[10][1] += " token = \"0123456789abcdef0123456789abcdef\""
    item = " ".join(f"benchmark{k}" for k in range(30))
    docs[20][1] += " " + item
    docs += [[1000 + k, docs[k][1], "en", "s", docs[k][4]] for k in range(0, 60, 2)]
    docs += [[2000, None, None, None, None], [2001, "", None, None, 0]]
    spark.createDataFrame([tuple(d) for d in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    bad = {d[0] for d in docs if any(c in (d[1] or "") for c in "#$%&|")}
    left = [(d[0], d[1]) for d in docs if not base(d[1])[-1] and d[0] not in bad]
    keep = {c for _, _, c in groups(left)}
    left = [x for x in left if x[0] in keep]
    gone = {d for d, _ in contaminated(left, [(1, item)])}
    lib = tokens.Library(tokens.default_path())
    want = {}
    for i, text in left:
        if i in gone:
            continue
        for start, _, end in reversed(secrets.base_spans(text)[:1]):
            text = text[:start] + "[SECRET]" + text[end + (text[end : end + 1] == "_") :]
        want[i] = (len(lib.encode(text)), hashlib.sha256(text.encode()).hexdigest())
    assert 20 in gone and 10 in want
    assert got == want


def test_stage_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
