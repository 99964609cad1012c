import io
import zlib

import numpy as np
from tests.llm.fixtures import documents, empty

from quillspark.llm import common, sstable, tokens


def test_file_round_trip_and_lookup():
    keys = sorted(sstable.key_of(i) for i in [None, *range(-50, 4000, 3), 7, 10, 10])
    out = io.BytesIO()
    w = sstable.Writer(out, block_bytes=300)
    for n, k in enumerate(keys):
        w.add(k, b"%d" % n)
    w.close()
    r = sstable.Reader(out, len(out.getvalue()))
    assert list(r.scan()) == [(k, b"%d" % n) for n, k in enumerate(keys)]
    assert len(r.places) > 20
    for k in set(keys):
        assert r.get(k) == [b"%d" % n for n, x in enumerate(keys) if x == k]
    assert not any(r.get(sstable.key_of(i)) for i in range(4001, 9000))


def test_documents(spark):
    docs = documents(spark).repartition(3)
    lib = tokens.Library(tokens.default_path())
    folder = common.fresh_path(spark, "sst")
    manifest = sstable.write(docs, folder)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = [*lib.encode(r.text or ""), 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in sstable.scan_digests(manifest, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert dict(sstable.lookup(manifest, folder, [3, 4, 99])) == {i: [*lib.encode(t or ""), 2] for i, t in ((r.doc_id, r.text) for r in rows) if i in (3, 4)}


def test_empty_table(spark):
    assert sstable.write_and_scan(spark, empty(spark)).collect() == []
