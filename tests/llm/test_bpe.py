import hashlib
import random

import pytest
from tests.llm.fixtures import documents, empty

from quillspark.llm import bpe, tokens


def test_pair_index_equals_the_library_on_random_words():
    lib = tokens.ByteLevel(tokens.default_path())
    rng = random.Random(3)
    words = list({"".join(rng.choice("aaaabbcdeinorst h") for _ in range(rng.randint(1, 40))).strip() or "a" for _ in range(3000)} | {"a" * k for k in range(1, 70)} | {"ab" * k for k in range(1, 40)})
    words = [w for w in words if " " not in w]
    ids, sizes = bpe.PairIndexBPE(lib).encode([w.encode() for w in words])
    at = 0
    for w, n in zip(words, sizes, strict=True):
        assert ids[at : at + n].tolist() == lib.encode(w)
        at += n


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_whole_texts(spark, name):
    docs = documents(spark)
    path = tokens.default_path(name)
    lib = tokens.Library(path)
    encoded = bpe.encode(docs, path=path)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encoded.collect()} == {k: lib.encode(t) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path=path).collect()} == {k: lib.decode(lib.encode(t)) for k, t in texts.items()}
    for r in bpe.encode_decode_digests(docs, path=path).collect():
        ids = lib.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_decode_digests(empty(spark)).collect() == []


def test_stretches_around_unstable_characters_equal_the_library():
    lib = tokens.ByteLevel(tokens.default_path())
    rng = random.Random(9)
    parts = ["word", " plain", "  ", " 🫠", "🫠", "­", "​", " ​ ", "日本", " it's", "\n\n", "12", ". ", "<|endoftext|>", "͸", "é", "᠎", "\t"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    cut = [lib.pretokens(x) for x in some]
    assert all("".join(p) == x for p, x in zip(cut, some, strict=True))
    assert any(not lib.splittable(x) and len(p) > 1 for p, x in zip(cut, some, strict=True))
    assert [[i for p in s for i in lib.encode(p)] for s in cut] == [lib.encode(x) for x in some]
    assert [x.tolist() for x in bpe.Codec(tokens.default_path()).encode(some)] == [lib.encode(x) for x in some]


#: Runs of one class that are far longer than any backtracking stack.
RUNS = [" " * 1_500_000 + "x", "\t" * 1_500_000 + "x", "a" * 1_500_000]


def test_very_long_runs_equal_the_library(spark):
    from quillspark.llm import sstable, token_counts

    docs = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    want = [tokens.Library(tokens.default_path()).encode(x) for x in RUNS]
    assert {r.doc_id: r.ids for r in bpe.encode(docs).collect()} == dict(enumerate(want))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {k: len(x) for k, x in enumerate(want)}
    assert {r.doc_id: r.n_tokens for r in sstable.write_and_scan(spark, docs).collect()} == {k: len(x) + 1 for k, x in enumerate(want)}


def test_both_engines_split_plain_texts_alike():
    lib = tokens.ByteLevel(tokens.default_path())
    rng = random.Random(4)
    chars = [*tokens.PLAIN, *"       \n\n\t'''sdmetlrv"]
    for _ in range(20_000):
        x = "".join(rng.choice(chars) for _ in range(rng.randint(1, 25)))
        assert lib._plain(x) == lib._any(x)
