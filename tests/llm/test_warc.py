import gzip
import hashlib
import re

import pytest

from mailgrid.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "x") for r in rows], "page_id long, url string, html string, _key string, page string"
    ).repartition(3)


ROWS = [
    (1, "http://a/", "short"), (2, None, None), (3, "x\r\nWARC/1.1\r\n", ""), (4, "u", "é" * 700),
    (5, "u", "é" * 700), (6, "u", "é" * 700), (6, "u", "é" * 700), (None, "u", "é" * 700),
    (None, "u", "z" * 2000), (None, "u", "z" * 2000), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 500),
    (8, "u", "日本😀" * 20_000), (9, "u", "s" * 999), (10, "u", "s" * 999),
]


def plain(rows):
    for page, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        top = max(same, default=None) if len(data) >= 1000 else None
        other = top is not None and page != top
        yield (
            page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response",
            top if other else None, "ok",
        )


def test_round_trip(spark):
    got = warc.archive_round_trip(pages_of(spark, ROWS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(ROWS)))


def test_no_pages(spark):
    assert warc.archive_round_trip(pages_of(spark, ROWS).filter("false")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(pages_of(spark, ROWS), folder)
    got = warc.read_archives(spark, folder).filter("record_type = 'response'").collect()
    texts = {r[0]: r[2] or "" for r in ROWS}
    for row in got:
        if row["page"] is not None:
            assert row["payload"] == texts[int(row["page"])]


@pytest.fixture
def segments():
    payload = ("abc é" * 9000).encode()
    records = warc.page_records("0-1", 5, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    return [r + b"\n" for r in records], payload.decode()


def read(spark, tmp_path, records):
    path = tmp_path / "one"
    path.mkdir()
    for n, record in enumerate(records):
        (path / f"{n}.warc.gz").write_bytes(gzip.compress(record))
    return warc.read_archives(spark, str(path)).collect()


def test_segments_from_many_archives_in_any_order(spark, tmp_path, segments):
    records, payload = segments
    (row,) = read(spark, tmp_path, [*reversed(records), records[1]])
    assert (row["status"], row["payload"]) == ("ok", payload)


@pytest.mark.parametrize("broken, status", [
    (lambda r: r[:1] + r[2:], "missing segment"),
    (lambda r: r[:-1], "missing segment"),
    (lambda r: [*r[:-1], r[-1].replace(b"Total-Length: ", b"Total-Length: 9")], "wrong length"),
    (lambda r: [r[0].replace(b"\r\n1000\r\n", b"\r\n0fff\r\n"), *r[1:]], "broken chunks"),
    (lambda r: [r[0], r[1].replace(b"abc", b"abd"), *r[2:]], "wrong digest"),
])
def test_broken_segments_are_named(spark, tmp_path, segments, broken, status):
    records, _ = segments
    (row,) = read(spark, tmp_path, broken(records))
    assert row["status"] == status
    assert row["page"] == "5"


def test_plain_records_too(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], body) + b"\n"
    (row,) = read(spark, tmp_path, [record])
    assert (row["payload"], row["status"]) == ("hello", "ok")


def test_records_have_what_the_format_demands(spark, tmp_path):
    folder = tmp_path / "archives"
    warc.write_archives(pages_of(spark, ROWS), str(folder))
    kinds, ids, origins, referred = {}, [], set(), set()
    for path in folder.glob("*.gz"):
        for headers, block in warc.parse_archive(gzip.decompress(path.read_bytes())):
            kind = headers["warc-type"]
            kinds.setdefault(kind, []).append(headers)
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["warc-date"])
            assert re.fullmatch("<urn:[^<> ]+>", headers["warc-record-id"])
            if kind == "continuation":
                origins.add(headers["warc-segment-origin-id"])
            else:
                assert headers["content-type"] == "application/http; msgtype=response"
            if kind == "revisit":
                assert headers["warc-profile"].endswith("identical-payload-digest")
                referred.add(headers["warc-refers-to"])
            if kind == "response" and headers["warc-page-id" if "warc-page-id" in headers else
                                               "warc-record-id"] not in ("6",):
                ids.append(headers["warc-record-id"])
    responses = {h["warc-record-id"] for h in kinds["response"]}
    assert len(ids) == len(set(ids)) and origins <= responses
    assert referred and referred <= responses
    assert set(kinds) == {"response", "revisit", "continuation"}


def test_revisit_without_its_response_is_named(spark, tmp_path):
    digest = hashlib.sha1(b"x" * 1000).hexdigest()
    (revisit,) = warc.page_records("0-1", 5, "u", b"x" * 1000, digest, 9)
    (row,) = read(spark, tmp_path, [revisit + b"\n"])
    assert (row["status"], row["refers"]) == ("no response", None)
