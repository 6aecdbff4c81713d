"""WARC and URL filters."""

from __future__ import annotations

import base64
import gzip
import hashlib

from signalbox.llm import url_filters, warc
from signalbox.llm.queries import QUERIES


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "http://c.example", ""),
    (5, "http://d.example/\r\ny", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://e.example/?q", "x" * 300_000),
    (6, "http://e.example/?q", "x" * 300_000), (None, "http://f.example/", "<p>one</p>"), (None, "http://g.example/", "alone"), (7, "http://a.example/x", "\r\n\r\n"),
    (8, "http://h.example", "<p>one</p>"), (9, "http://a.example/z", "é"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "q", "w") for r in rows], "page_id long, url string, html string, digest string, id string")


def test_round_trip_matches_plain_rules(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op9_warc_transactions"](spark, str(tmp_path)).collect()
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected, seen = [], set()
    for i, _, html in PAGES:
        b = (html or "").encode()
        again = (html or "") in first and (i != first[html or ""] or html in seen)
        seen |= {html} if i is not None and first[html or ""] == i else set()
        expected.append((i, len(b), digest(b), "revisit" if again else "response", first[html or ""] if again else None))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found])) == sorted(map(str, expected))
    assert all(r.n_requests == 1 for r in found)


def test_payloads_come_back_byte_for_byte(spark, tmp_path):
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write_archives(pages(spark), path, compression=compression)
        records = warc.read_archives(spark, path).collect()
        payloads = sorted(bytes(r.payload).decode() for r in records if r.type == "response")
        assert payloads == sorted({html or "" for _, _, html in PAGES})
        assert len(records) == 3 * len(PAGES) == len({r.record_id for r in records}) and all(r.complete for r in records)


def test_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op9_warc_transactions"](spark, str(tmp_path)).count() == 0


def record(kind, rid, *concurrent):
    return (rid, kind, "u", list(concurrent), None, None, 0, None, None, True)


def test_assembly_follows_identifiers_both_ways_and_over_hops(spark):
    rows = [
        record("response", "r1"), record("request", "q1", "r1"), record("metadata", "m1", "q1"), record("metadata", "m2", "m1"), record("metadata", "m2", "m1"),
        record("response", "r2", "q2"), record("request", "q2"), record("revisit", "r3"), record("request", "q4", "missing"), record("metadata", "c1", "c2"),
        record("metadata", "c2", "c1"), record("request", "q5", "r3", "r1"), record("metadata", None, "r1"),
    ]
    found = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc._READ)).collect()}
    ids = {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata], r.main and r.main.type) for k, r in found.items()}
    assert ids == {
        "r1": (["q1", "q5"], ["m1", "m2"], "response"), "r2": (["q2"], [], "response"), "r3": ([], [], "revisit"),
        "q4": (["q4"], [], None), "c1": ([], ["c1"], None), "c2": ([], ["c2"], None)}


ONE = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
TWO = b"WARC/1.0\r\nwarc-type: metadata\r\nWARC-Record-ID: <b>\r\ncontent-length: 6\r\n\r\nk: v\r\n\r\n\r\n"


def test_parser_takes_pieces_of_any_size_and_skips_rubbish():
    data = ONE + b"noise WARC/1. \n" + TWO
    for size in (1, 2, 7, 50, 1000):
        pieces = [data[i:i + size] for i in range(0, len(data), size)]
        found = list(warc.parse_records(pieces, True))
        assert [(r["record_id"], r["payload"], r["fields"], r["complete"]) for r in found] == [
            ("<a>", b"ab\r\nc", None, True), ("<b>", b"k: v\r\n", [("k", "v")], True)]
    assert list(warc.parse_records([], True)) == [] and list(warc.parse_records([b"WARC/1.0\r\nContent-Length: x\r\n\r\n"], True)) == []


def test_records_that_are_cut_off_say_so(spark, tmp_path):
    whole = ONE + TWO + ONE.replace(b"resource", b"response").replace(b"<a>", b"<c>").replace(b": 5", b": 900")
    (tmp_path / "cut").write_bytes(whole)
    (tmp_path / "members.gz").write_bytes(gzip.compress(ONE) + gzip.compress(TWO) + gzip.compress(TWO.replace(b"<b>", b"<d>")))
    found = sorted((r.record_id, r.complete, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert found == [("<a>", True, None), ("<a>", True, None), ("<b>", True, None), ("<b>", True, None), ("<c>", False, None), ("<d>", True, None)]


def test_damaged_files_are_skipped_on_demand(spark, tmp_path):
    many = b"".join(ONE.replace(b"<a>", b"<%d>" % i) for i in range(20_000))
    (tmp_path / "half.gz").write_bytes(gzip.compress(many)[:30_000])
    (tmp_path / "padded.gz").write_bytes(gzip.compress(ONE) + b"\0" * 100)
    (tmp_path / "whole.gz").write_bytes(gzip.compress(TWO))
    found = [r for r in warc.read_archives(spark, str(tmp_path), skip_damaged=True).collect() if r.complete]
    ids = {r.record_id for r in found}
    assert "<b>" in ids and 100 < len(ids) < 20_000


def test_a_payload_may_end_or_begin_like_a_separator(spark, tmp_path):
    odd = ["\r\n\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nxx", "a\r\n\r\n\r\n\r\n", "\r\n\r\nWARC/1." * 2000, "y" * 70_000 + "\r\n\r\nWARC/1", "WARC/1.1", "\r"]
    rows = [(i, "http://a.example/", text) for i, text in enumerate(odd)]
    warc.write_archives(pages(spark, rows).coalesce(1), f"{tmp_path}/odd")
    records = warc.read_archives(spark, f"{tmp_path}/odd").collect()
    assert sorted(bytes(r.payload).decode() for r in records if r.type == "response") == sorted(odd) and len(records) == 3 * len(odd)


def test_many_equal_rows_are_as_many_captures(spark, tmp_path):
    rows = [(1, "http://a.example/", "same")] * 40 + [(None, None, None)] * 3
    found = warc.archived(pages(spark, rows)).where("main is not null").selectExpr("main.type as type", "main.payload_bytes as n").groupBy("type", "n").count().collect()
    assert {(r.type, r.n): r["count"] for r in found} == {("response", 4): 1, ("revisit", 4): 39, ("response", 0): 1, ("revisit", 0): 2}


# URL filters

ENTRIES = [
    ("l", "Bad.example", "add", 10), ("l", "bad.example", "add", 12), ("l", "bad.example", "remove", 50), ("l", "bad.example", "add", 90),
    ("l", "ok.example/ads", "add", 0), ("l", "x.example", "remove", 5), ("l", "same.example", "add", 7), ("l", "same.example", "remove", 7),
    ("m", "sub.bad.example", "add", 20), (None, "z.example", "add", 1), ("l", None, "add", 1), ("l", "y.example", "drop", 1), ("l", "y.example", "add", None),
]


def test_intervals(spark):
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, at long")
    found = {tuple(r) for r in url_filters.validity_intervals(entries).collect()}
    assert found == {("l", "bad.example", 10, 50), ("l", "bad.example", 90, None), ("l", "ok.example/ads", 0, None),
                     ("l", "same.example", 7, None), ("m", "sub.bad.example", 20, None)}


def test_captures_meet_the_list_of_their_time(spark):
    intervals = url_filters.validity_intervals(spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, at long"))
    rows = [
        (1, "http://BAD.example/x", 9), (2, "http://bad.example/x", 10), (3, "http://u@bad.example:80/x", 49), (4, "http://bad.example/", 50), (5, "http://bad.example", 900),
        (6, "http://a.sub.bad.example/q?x#y", 30), (6, "http://a.sub.bad.example/q?x#y", 30), (7, "http://ok.example/ads/1", 3), (8, "http://ok.example/adsense", 3),
        (9, None, 3), (10, "no url", 3), (11, "http://bad.example/", None), (None, "http://notbad.example/", 20), (12, "http://", 20),
    ]
    captures = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, fetched long, pattern string")
    found = sorted(((r.page_id, r.n_matches, r.pattern) for r in url_filters.judged(captures, intervals).collect()), key=str)
    assert found == sorted([
        (1, 0, None), (2, 1, "bad.example"), (3, 1, "bad.example"), (4, 0, None), (5, 1, "bad.example"), (6, 2, "sub.bad.example"), (6, 2, "sub.bad.example"),
        (7, 1, "ok.example/ads"), (8, 0, None), (9, 0, None), (10, 0, None), (11, 0, None), (None, 0, None), (12, 0, None)], key=str)


def test_captures_with_clashing_names_and_times_in_seconds(spark):
    intervals = url_filters.validity_intervals(spark.createDataFrame(
        [(name, pattern, action, at * 86_400) for name, pattern, action, at in ENTRIES if at is not None] + [("l", "bad.example", "remove", 10**9)],
        "list_name string, pattern string, action string, at long"))
    rows = [(1, "http://bad.example/x", 10 * 86_400, "a", 7, "s"), (2, "http://bad.example/x", 60 * 86_400, "b", 8, "t"), (3, "http://bad.example/x", 10**9 - 1, "c", 9, "u"),
            (4, "http://bad.example/x", 10**9, "d", 9, "u")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched long, _url string, _at long, slice string")
    found = url_filters.judged(captures, intervals)
    assert found.columns == [*captures.columns, "blocked", "n_matches", "list_name", "pattern", "valid_from"]
    assert sorted((r.page_id, r["_url"], r["_at"], r["slice"], r.blocked) for r in found.collect()) == [
        (1, "a", 7, "s", True), (2, "b", 8, "t", False), (3, "c", 9, "u", True), (4, "d", 9, "u", False)]


def test_no_captures_or_no_entries(spark):
    none = url_filters.validity_intervals(spark.createDataFrame([], "list_name string, pattern string, action string, at long"))
    captures = spark.createDataFrame([(1, "http://a.example/", 1)], "page_id long, url string, fetched long")
    assert [r.blocked for r in url_filters.judged(captures, none).collect()] == [False]
    some = url_filters.validity_intervals(spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, at long"))
    assert url_filters.judged(captures.limit(0), some).count() == 0
