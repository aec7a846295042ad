import base64
import gzip
import hashlib
import io

import pytest

from quire.llm import warc as W


def test_normalised_members_hold_the_same_records():
    pages = [(k, f"http://a/{k}%0A" + "\n" * (k % 2), (b"<p>\r\n\r\n%d" % k) * (k * 5000), None if k % 3 else 0) for k in range(12)]
    raw = b"".join(W.record(*p) for p in pages)
    out = io.BytesIO()
    index = W.normalise(io.BytesIO(gzip.compress(raw)), out)
    data = out.getvalue()
    assert gzip.decompress(data) == raw and len(index) == 12
    for p, at in zip(pages, index, strict=True):
        one = W.parsed(gzip.decompress(data[at["offset"] : at["offset"] + at["length"]]))
        assert one["page_id"] == p[0] and one["url"] == p[1] and one["payload_bytes"] == len(p[2]) and one["refers_to"] == p[3]
        assert one["payload"] == (p[2] if p[3] is None else None)
    # a file of several members reads like one of a single member
    again = io.BytesIO()
    W.normalise(io.BytesIO(data), again)
    assert again.getvalue() == data
    with pytest.raises(ValueError):
        list(W.records([raw[:-5]]))


def test_tables(spark):
    from quire.plans.staging import new_path

    rows = [(3, "u", "same"), (1, "v", "same"), (1, "v", "same"), (2, None, None), (4, "w", ""), (None, "x", "same"), (None, "y", "only"), (7, "é\n", "ü" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    folder = new_path(spark, "warc-test")
    chosen = W.choose(pages)
    W.write_archives(chosen, folder)  # an attempt that was lost: its files are not read
    read = W.read_archives(W.normalise_archives(W.write_archives(chosen, folder), folder))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read.collect()]
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, "response", None, 4, d("same"))] * 2 + [(3, "revisit", 1, 4, d("same")), (None, "revisit", 1, 4, d("same"))]
    want += [(2, "response", None, 0, d("")), (4, "revisit", 2, 0, d("")), (None, "response", None, 4, d("only"))]
    want += [(7, "response", None, 600_000, d("ü" * 300_000))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    none = W.write_archives(W.choose(pages.limit(0)), new_path(spark, "warc-none"))
    assert W.read_archives(W.normalise_archives(none, new_path(spark, "warc-none"))).count() == 0
