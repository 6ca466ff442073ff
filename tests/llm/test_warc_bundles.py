import hashlib
import os

import zstandard

from rankweave.llm import warc_bundles as W


def pages(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/ä b\r\nc", big), (None, None, big), (3, None, "x" * 999), (4, "u", "x" * 999),
            (5, "u", None), (6, "u", ""), (7, "u", "y" * 3_000_000), (8, "u", big), (8, "u", big), (9, "u", "z\r\n\r\n" * 500)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, frame int")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        top, first = max(ids, key=lambda i: (i is not None, i)), True
        for i in ids:
            response = len(raw) < 1000 or len(ids) == 1 or (i == top and first)
            first = first and not (i == top)
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


def test_round_trip(spark):
    p = pages(spark)
    assert sorted(map(tuple, W.warc_round_trip(p).collect()), key=repr) == brute(p.collect())
    assert W.warc_round_trip(p.limit(0)).count() == 0


def test_index_leads_to_each_record(spark, tmp_path):
    p = pages(spark).where("page_id <> 8")
    index = W.write_bundles(p, str(tmp_path)).collect()
    assert len(index) == p.count()
    html = {r.page_id: (r.html or "").encode() for r in p.collect()}
    for r in index:
        raw = (tmp_path / r.bundle).read_bytes()
        headers, block = W.read_one(raw, r.frame, r.record_at, r.record_bytes)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and headers["WARC-Type"] == r.type
        assert W.frames_of(raw)[r.frame][0] == r.frame_at
        if r.type == "response":
            assert block.split(b"\r\n\r\n", 1)[1] == html[r.page_id]
    assert set(r.bundle for r in index) == {f for f in os.listdir(tmp_path) if not f.endswith(".crc")}


def test_only_bundles_of_the_index_are_read(spark, tmp_path):
    """What attempts left that died or ran again is never read, whatever it holds."""
    p = pages(spark)
    W.write_bundles(p.where("page_id > 3"), str(tmp_path))       # another attempt's bundles
    index = W.write_bundles(p, str(tmp_path))
    named = sorted(r.bundle for r in index.select("bundle").distinct().collect())
    (tmp_path / named[0].replace(".warc", "x.warc")).write_bytes((tmp_path / named[0]).read_bytes()[:50])  # cut off
    assert sorted(map(tuple, W.read_bundles(spark, str(tmp_path), index).collect()), key=repr) == brute(p.collect())


def test_a_bundle_is_plain_zstandard():
    w = W.BundleWriter()
    records = [W.write_record(k, "u", bytes([65 + k]) * 700_000, "d", None, False) for k in range(3)]
    for k, r in enumerate(records):
        w.add(k, "response", r)
    raw = w.finish()
    assert len(W.frames_of(raw)) == 2
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
        assert f.read() == b"".join(records)
