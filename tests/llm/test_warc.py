import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelode.llm import warc
from tracelode.llm.common import ship


def make(n, zipped, seed=1, payload=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = payload or bytes(rng.randrange(32, 127) for _ in range(rng.randrange(0, 3000)))
        headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Block-Digest": "sha1:" + hashlib.sha1(body).hexdigest()}
        data = warc.record_bytes(headers, body)
        out.append(warc.member(data) if zipped else data)
    return out


def ids(path, step=None):
    size = len(open(path, "rb").read())
    ranges = [(0, size)] if step is None else [(a, a + step) for a in range(0, size, step)]
    return [r.headers["warc-record-id"] for a, b in ranges for r in warc.salvage(str(path), a, b) if isinstance(r, warc.Record)]


def test_whole_archives_and_ranges(tmp_path):
    for zipped in (True, False):
        path = tmp_path / ("a.gz" if zipped else "a")
        path.write_bytes(b"".join(make(60, zipped)))
        want = [f"<urn:page:{i}>" for i in range(60)]
        assert ids(path) == want
        assert ids(path, 997) == want


def test_damage_is_passed_over(tmp_path):
    for zipped in (True, False):
        parts = make(40, zipped, seed=2)
        for i in (0, 7, 8, 39):
            b = bytearray(parts[i])
            b[len(b) // 2] ^= 0xFF
            parts[i] = bytes(b)
        parts[20] = parts[20][: len(parts[20]) // 2]  # cut off
        parts.insert(30, b"\x1f\x8b\x08 WARC/1.1\r\nrubbish")
        path = tmp_path / f"b{zipped}"
        path.write_bytes(b"".join(parts))
        lost = {0, 7, 8, 20, 39}
        want = [f"<urn:page:{i}>" for i in range(40) if i not in lost]
        assert ids(path) == want
        assert ids(path, 1009) == want


def test_damage_to_the_first_bytes_and_mixed_archives(tmp_path):
    plain, packed = make(12, False, seed=5), make(12, True, seed=5)
    broken = lambda parts: [b"\0" * 5 + parts[0][5:], *parts[1:]]
    mixed = [(plain, packed)[i % 2][i] for i in range(12)]
    cases = [(broken(plain), 1), (broken(packed), 1), ([b"junk", *plain], 0), ([b"junk", *packed], 0), ([b"WARC/1.1\r\nrubbish", *packed], 0), ([b"\x1f\x8b\x08junk", *plain], 0), (mixed, 0), (broken(mixed), 1)]
    for k, (parts, first) in enumerate(cases):
        path = tmp_path / f"d{k}"
        path.write_bytes(b"".join(parts))
        want = [f"<urn:page:{i}>" for i in range(first, 12)]
        assert ids(path) == want
        assert ids(path, 1009) == want


def written(kind, digest, body, extra="", http=False, block=True):
    block_bytes = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + extra.encode() + b"\r\n" + body) if http else body
    headers = {"WARC-Type": kind, "WARC-Record-ID": "<urn:page:0>", **({"Content-Type": "application/http; msgtype=response"} if http else {})}
    headers["WARC-Block-Digest" if block else "WARC-Payload-Digest"] = digest(block_bytes if block else body)
    return warc.record_bytes(headers, block_bytes)


BASE32 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
FORMS = {
    "hex": lambda b: "sha1:" + hashlib.sha1(b).hexdigest(),
    "base32": BASE32,
    "lower base32": lambda b: BASE32(b).lower(),
    "sha-256": lambda b: "SHA-256:" + hashlib.sha256(b).hexdigest(),
    "sha256 base32": lambda b: "sha256:" + base64.b32encode(hashlib.sha256(b).digest()).decode(),
    "md5": lambda b: "md5:" + hashlib.md5(b).hexdigest(),
}


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("form", [*FORMS, "unknown", "cut"])
def test_digests_of_any_form(tmp_path, form, zipped):
    digest = FORMS.get(form, lambda b: {"unknown": "blake3:abc", "cut": "sha1:abc"}[form])
    pack = warc.member if zipped else bytes
    for block in (True, False):
        good = [written("response", digest, b"body %d" % i, http=True, block=block) for i in range(5)]
        path = tmp_path / f"{block}"
        path.write_bytes(b"".join(map(pack, good)))
        assert len(ids(path)) == 5
        bad = good[2].replace(b"body 2", b"bodz 2")
        path.write_bytes(b"".join(map(pack, [*good[:2], bad, *good[3:]])))
        assert len(ids(path)) == (4 if form in FORMS else 5)  # one flipped byte quarantines one record, where a digest can be read


def test_which_digests_count(tmp_path):
    wrong = lambda b: "sha1:" + "0" * 40
    cases = [
        (written("revisit", wrong, b"", http=True), 0),  # a block digest counts for revisits too
        (written("revisit", wrong, b"", http=True, block=False), 1),  # their payload is elsewhere
        (written("response", wrong, b"x", extra="Transfer-Encoding: chunked\r\n", http=True, block=False), 1),
        (written("response", wrong, b"x", http=True, block=False), 0),
        (written("resource", wrong, b"x"), 0),
    ]
    for i, (data, found) in enumerate(cases):
        for pack in (warc.member, bytes):
            (tmp_path / str(i)).write_bytes(pack(data))
            assert len(ids(tmp_path / str(i))) == found


def test_folded_headers_and_long_ones(tmp_path):
    data = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:0>\r\nX-Note: one\r\n two\r\n\tthree\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    for pack in (warc.member, bytes):
        (tmp_path / "f").write_bytes(pack(data))
        (record,) = warc.salvage(str(tmp_path / "f"))
        assert record.headers["x-note"] == "one two three"
    long = warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:0>", "X": "y" * (3 << 20)}, b"z")
    (tmp_path / "g").write_bytes(long)
    assert [x.reason for x in warc.salvage(str(tmp_path / "g"))] == [f"header longer than {1 << 20} bytes"]
    assert len(list(warc.salvage(str(tmp_path / "g"), most_header=4 << 20))) == 1


def test_members_of_several_records(spark, tmp_path):
    ship(spark)
    plain = make(9, False, seed=8)
    broken = bytearray(plain[4])
    broken[len(broken) // 2] ^= 1
    data = b"".join([warc.member(b"".join(plain[:3])), warc.member(plain[3] + bytes(broken) + plain[5]), warc.member(b""), warc.member(b"".join(plain[6:]))])
    path = tmp_path / "m"
    path.write_bytes(data)
    want = [f"<urn:page:{i}>" for i in range(9) if i != 4]
    assert ids(path) == want and ids(path, 500) == want
    archives = spark.createDataFrame([(str(path), len(data))] * 2, "path string, bytes long")  # named twice
    found = warc.scan_warc(archives)
    assert sorted(r.record_id for r in warc.chained(found).collect()) == want
    reasons = [r.reason for r in sorted(warc.gaps(found, archives).collect(), key=lambda r: r.start)]
    assert reasons == ["warc-block-digest does not match", "no sound header"]


def test_gaps_and_nested_records(spark, tmp_path):
    ship(spark)
    parts = make(6, False, seed=3)
    parts[2] = b"X" * len(parts[2])
    inner = b"".join(make(3, False, seed=4))
    parts.append(make(1, False, payload=b"see: " + inner + b" end")[0])
    data = b"".join(parts) + b"tail"
    path = tmp_path / "c"
    path.write_bytes(data)
    archives = spark.createDataFrame([(str(path), len(data)), (None, 5)], "path string, bytes long")
    old, warc.RANGE_BYTES = warc.RANGE_BYTES, len(b"".join(parts[:6])) + 150  # a range that begins inside the last record
    try:
        records = warc.read_warc(archives, payloads=True).collect()
        found = sorted((r.start, r.end, r.reason) for r in warc.gaps(warc.scan_warc(archives), archives).collect())
    finally:
        warc.RANGE_BYTES = old
    at = len(b"".join(parts[:2]))
    assert len(records) == 6 and found == [(at, at + len(parts[2]), "no sound header"), (len(data) - 4, len(data), "no mark of a record")]


def test_what_is_too_long_is_logged(spark, tmp_path):
    ship(spark)
    packed, plain = make(4, True, seed=6), make(4, False, seed=6)
    big = warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:9>"}, b"z" * 9000)
    header = warc.record_bytes({"WARC-Type": "resource", "X-Filler": "y" * (2 << 20)}, b"")
    data = b"".join([*packed, warc.member(big), *plain, big, header, plain[0], packed[0][:-9]])
    (tmp_path / "e").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "e"), len(data))], "path string, bytes long")
    found = warc.scan_warc(archives, most=8000)
    assert warc.chained(found).count() == 9
    reasons = [r.reason for r in sorted(warc.gaps(found, archives).collect(), key=lambda r: r.start)]
    assert reasons == ["longer than 8000 bytes"] * 2 + ["gzip member is cut off"]
    assert warc.gaps(warc.scan_warc(archives.limit(0)), archives.limit(0)).count() == 0


def test_pages_come_back(spark):
    ship(spark)
    big, small = "<p>ä" * 400, "<p>x"
    rows = [(1, "http://a", big, 0), (2, "http://b", big, 0), (5, None, big, 0), (3, "u", small, 0), (4, "u", small, 0), (6, "u", None, 0), (7, "u", "", 0), (8, "u\r\nx", "y" * 1000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = {r.page_id: r for r in warc.page_records(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if page_id in (1, 2) else ("response", None))
    assert warc.page_records(pages.where("page_id is null")).count() == 0


def test_repeated_and_null_page_ids(spark):
    ship(spark)
    big = "<p>b" * 300
    rows = [(5, "a", big), (5, "b", big), (4, "c", big), (None, "d", big), (None, "e", "f" * 2000), (None, "g", "f" * 2000)]
    got = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([("5", "response", "None")] * 2 + [("4", "revisit", "5"), ("None", "revisit", "5")] + [("None", "response", "None")] * 2)


def test_damaged_pages_are_an_error(spark, monkeypatch):
    ship(spark)
    true = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda pages: true(pages).withColumn("bytes", F.col("bytes") + 3))
    with pytest.raises(RuntimeError):
        warc.page_records(spark.createDataFrame([(1, "a", "b")], "page_id long, url string, html string"))
