import base64
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, warc

ROWS = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "same", "same", "same", "big " * 9000, "ünï\r\n\r\n", "a\x00b", "same", "ünï\r\n\r\n"])] + [(8, None, "same"), (None, "u\r\nX: y", "same"), (None, None, "alone"), (None, None, "alone")]


@pytest.mark.parametrize("least", [0, 3, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "last", "copies", "refers_to")})
    folder = common.fresh_path(spark, "warc")
    got = warc.read_archives(warc.write(pages, folder, min_revisit_bytes=least, train_bytes=5000), folder).collect()
    want = Counter()
    for i, _, h in ROWS:
        p = (h or "").encode()
        ids = [j for j, _, g in ROWS if (g or "").encode() == p]
        top = max((j for j in ids if j is not None), default=None)
        revisit = len(ids) > 1 and len(p) >= least and top is not None and i != top
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else p] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_dictionary_helps_and_frames_stand_alone():
    out = io.BytesIO()
    w = warc.Writer(out, 4096, 50_000, 3)
    data = [warc.record(i, "http://x", f"<html><body class='page main'>{i * 7919 % 997} text</body></html>".encode(), None, False) for i in range(500)]
    for d in data:
        w.add(d)
    w.close()
    assert list(warc.read(io.BytesIO(out.getvalue()))) == data
    assert len(out.getvalue()) < sum(map(len, data)) / 3


def test_empty_table(spark):
    assert warc.archive_digests(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
