import gzip
import hashlib
import random

import pytest

from paperloom.llm import warc


def test_chunked_framing():
    for body in (b"", b"x", bytes(range(256)) * 99, b"\r\n0\r\n\r\n"):
        for size in (1, 7, 8192):
            assert warc.unchunked(warc.chunked(body, size)) == body
    assert warc.unchunked(b"3;name=value\r\nabc\r\n0\r\ntrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


PAGES = "page_id long, url string, html string, first long, digest int, row_id string"


def pages(rng):
    big = "".join(rng.choice("abc<é>\r\n") for _ in range(200_000))
    rows = [(1, "http://a/x y", None), (2, None, ""), (3, "http://b", "short"), (4, "http://b", "short"), (5, "u", big), (6, "u", big), (7, "u", "é" * 50), (8, "u", "é" * 50),
            (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "WARC/1.1\r\n\r\n\r\n" * 40)]
    return rows + [(k, f"http://h/{k}", "".join(rng.choice("ab \r\n") for _ in range(rng.randint(0, 3000)))) for k in range(20, 60)]


def test_round_trip(spark, tmp_path):
    rows = pages(random.Random(1))
    df = spark.createDataFrame([(*r, 7, 8, "x") for r in rows] + [(None, "u", "no id", 7, 8, "x")], PAGES)
    config = warc.Config(segment=4096, chunk=1000, records_per_file=9)
    warc.write(df, str(tmp_path / "w"), config=config)
    found = warc.resolve(warc.read(spark, str(tmp_path / "w")))
    got = {r.row_id: r for r in found.collect()}
    assert bytes(got.pop(None).payload) == b"no id" and len(got) == len(rows) and not [r.problem for r in got.values() if r.problem]
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        if len(data) >= 100 and data in first:
            assert (got[i].type, got[i].refers_to, got[i].payload) == ("revisit", first[data], None)
        else:
            first.setdefault(data, i)
            assert (got[i].type, got[i].refers_to, bytes(got[i].payload)) == ("response", None, data)
        assert got[i].digest == hashlib.sha256(data).hexdigest()
    sizes = {r.row_id: r.payload_bytes for r in found.collect() if r.row_id is not None}
    assert sizes == {i: len((h or "").encode()) for i, _, h in rows}
    slim = warc.read(spark, str(tmp_path / "w"), payload=False)
    assert slim.filter("payload is not null or problem is not null").count() == 0 and slim.count() == len(rows) + 1
    assert warc.read_parts(spark, str(tmp_path / "w")).filter("type = 'continuation'").count() > 20


def test_damaged_archives(spark, tmp_path):
    def made(segments, body=b"x" * 9000):
        return [r + b"\r\n" for r in warc.records(5, "u", body, hashlib.sha256(body).hexdigest(), None, warc.Config(segment=segments, chunk=500))]

    whole = made(3000)
    cases = {"missing": whole[:1] + whole[2:], "twice": whole[:2] + whole[1:], "tail": whole[:-1], "orphan": whole[1:], "fine": whole[::-1],
             "digest": [made(10**6)[0].replace(b"xxx", b"xyx", 1)]}
    want = {"missing": "segments missing or repeated", "twice": "segments missing or repeated", "tail": "another total length", "orphan": "no origin", "fine": None, "digest": "another digest"}
    for name, parts in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
        got = warc.read(spark, str(tmp_path / name)).collect()
        assert [r.problem for r in got] == [want[name]]
    assert bytes(warc.read(spark, str(tmp_path / "fine")).first().payload) == b"x" * 9000
    assert [p for _, _, p in warc.parse(whole[0][:-10])] == ["cut short"]
    assert list(warc.parse(b"")) == []


def foreign(kind, payload, digest, **more):
    """A record as other writers make them: SHA-1 in base 32, no private headers, a length of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{len(payload)}-{kind}>", "WARC-Target-URI": "http://h/", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest, "Content-Length": len(http)}
    head = {k: v for k, v in (head | more).items() if v is not None}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + http + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import base64

    page = b"<p>a page</p>" * 30
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 14\r\n\r\nsoftware: x\r\n\r\r\n\r\n"
    parts = [info, foreign("response", page, sha1), foreign("response", page + b"!", sha1), foreign("response", page, "blake3:00", **{"WARC-Record-ID": "<b>"}),
             foreign("response", page, None, **{"Content-Length": None, "WARC-Record-ID": "<n>"}), foreign("response", page, "md5:" + hashlib.md5(page).hexdigest(), **{"WARC-Record-ID": "<m>"}),
             b"noise between records\r\n", foreign("revisit", b"", sha1, **{"WARC-Refers-To": f"<urn:uuid:{len(page)}-response>"}), foreign("response", page, sha1, **{"WARC-Record-ID": "<z>"})[:-100]]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(parts))
    got = warc.resolve(warc.read(spark, str(tmp_path / "plain"))).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == len(parts)
    first = by[f"<urn:uuid:{len(page)}-response>"]
    assert (bytes(first.payload), first.digest, first.problem, first.row_id) == (page, sha1, None, None)
    assert by[f"<urn:uuid:{len(page) + 1}-response>"].problem == "another digest" and by["<b>"].problem is None and bytes(by["<m>"].payload) == page
    assert by["<n>"].problem == "no length" and by["<z>"].problem == "cut short"
    revisit = by["<urn:uuid:0-revisit>"]
    assert revisit.payload_bytes == len(page) and revisit.payload is None
    assert sorted(r.problem for r in got if r.record_id is None and r.problem) == ["no record"]
    whole = gzip.compress(parts[1]) + gzip.compress(parts[1])
    for name, data, problems in (("gz", whole, [None, None]), ("half", whole[:-20], [None, "archive cut short", "cut short"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        assert sorted((r.problem for r in warc.read(spark, str(tmp_path / name)).collect()), key=str) == problems


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    big = "c" * 9000
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "v", "b"), (2, "u", big), (2, "u", big), (3, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "r"), config=warc.Config(segment=2000))
    got = warc.resolve(warc.read(spark, str(tmp_path / "r"))).collect()
    assert sorted((r.row_id, r.type, r.payload_bytes, r.refers_to, r.problem) for r in got if r.row_id < 3) == [(1, "response", 1, None, None)] * 3 + [(2, "response", 9000, None, None)] * 2
    assert [(r.type, r.payload_bytes, r.refers_to) for r in got if r.row_id == 3] == [("revisit", 9000, 2)]
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
