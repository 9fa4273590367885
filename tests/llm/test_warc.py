"""WARC bundles: exact round trip, record types, the seek table and single records."""

import hashlib

import zstandard
from pyarrow import fs as pafs

from facetmill.llm.common import shared_dir
from facetmill.llm.warc import archive_round_trip, parse_records, read_archives, read_record, read_seek_table, write_archives

SCHEMA = "page_id long, url string, html string, payload string, refers_to string"
BIG, UMLAUT = "<p>big</p>" * 200, "ä" * 500
HTML = {1: BIG, 2: None, 3: "", 4: BIG, 5: "x" * 999, 6: "x" * 999, 7: UMLAUT, 8: UMLAUT, 9: BIG, 10: "WARC/1.1\r\n\r\n" * 90, 11: "y" * 300_000, 12: "\r\n\r\n"}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "r") for i, u, h in rows], SCHEMA)


def test_round_trip(spark):
    rows = [(i, f"http://a.org/{i} ü\r\nx", h) for i, h in HTML.items()] + [(13, None, "z"), (None, "u", BIG), (5, "twice", "x" * 999)]
    out = shared_dir(spark, "warc-test")
    index = write_archives(pages(spark, rows), out, frame_bytes=4000, bundle_bytes=100)
    got = read_archives(spark, out).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    html = dict((i, h) for i, _, h in rows)
    for r in got:
        payload = (html[r.page_id] or "").encode()
        same = [i for i, h in html.items() if i is not None and (h or "").encode() == payload]
        top = max(same) if len(payload) >= 1000 and same else None
        revisit = top is not None and top != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else payload)
    assert {r.page_id: r.refers_to for r in got}[7] == 8  # 1000 bytes, 500 characters
    places = index.collect()
    assert len(places) == len(rows) and len({p.bundle for p in places}) > 1
    for p in places:
        headers, payload = read_record(out, p.bundle, p.frame_offset, p.frame_bytes, p.offset)
        assert headers["warc-record-id"] == p.record_id
        assert headers["warc-type"] == "revisit" or payload == (html[p.page_id] or "").encode()
    filesystem, path = pafs.FileSystem.from_uri(f"{out}/bundles")
    for name in {p.bundle for p in places}:
        raw = filesystem.open_input_file(f"{path}/{name}").read()
        frames = read_seek_table(lambda at, n, raw=raw: raw[at : at + n], len(raw))
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert whole == b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + p]) for a, p, _ in frames)
        assert len(list(parse_records(whole))) == sum(p.bundle == name for p in places)


def test_empty_table(spark):
    assert archive_round_trip(pages(spark, [])).count() == 0
