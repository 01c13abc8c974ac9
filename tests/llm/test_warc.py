"""The salvage reader on damaged files, and the archive's round trip."""

import base64
import gzip
import hashlib
import random

import pytest

from ledgerfold.errors import Corruption
from ledgerfold.llm import warc
from ledgerfold.llm.queries_warc import op5_warc
from ledgerfold.llm.warc import archive_pages, page_records, read_warc, salvage, write_warc


def record(k, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{k}>", "WARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest(), "WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest(), "Content-Type: application/http", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def covered(raw, rows):
    spans = sorted({(r["start"], r["stop"]) for r in rows})
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(raw)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("damage", ["none", "version", "length", "payload", "cut", "lost terminator", "noise between", "noise first"])
def test_records_after_damage_are_recovered(packed, damage):
    payloads = [b"<p>%d</p>" % k * 300 for k in range(5)]
    parts = [gzip.compress(record(k, p)) if packed else record(k, p) for k, p in enumerate(payloads)]
    lost = {2}
    if damage == "none":
        lost = set()
    elif damage == "version":
        parts[2] = b"XARC" + parts[2][4:]
    elif damage == "length":
        parts[2] = parts[2][:10] + b"\0" * 20 + parts[2][30:]
    elif damage == "payload":
        parts[2] = parts[2][:-20] + b"#" * 5 + parts[2][-15:]
    elif damage == "cut":
        parts[2] = parts[2][: len(parts[2]) // 2]
    elif damage == "lost terminator":
        parts[2] = parts[2][:-4]
        lost = set() if packed else lost  # the length in the member's trailer is cut off; its record's digests hold
    elif damage == "noise between":
        parts[2:2], lost = [b"\x1f\x8b\x08noise WARC/1.1\r\n noise"], set()
    else:
        parts[:0], lost = [b"noise"], set()
    raw = b"".join(parts)
    rows = list(salvage(raw))
    covered(raw, rows)
    assert [(r["record_id"], r["payload"]) for r in rows if r["kind"] == "record"] == [(str(k), p) for k, p in enumerate(payloads) if k not in lost]
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == (damage != "none") and all(r["why"] for r in gaps)


@pytest.mark.parametrize("seed", range(20))
def test_any_flipped_bytes_lose_only_their_records(seed):
    rng = random.Random(seed)
    parts = [record(k, bytes(rng.randrange(256) for _ in range(rng.randrange(400)))) for k in range(12)]
    if seed % 2:
        parts = [gzip.compress(p) for p in parts]
    starts = [sum(map(len, parts[:k])) for k in range(12)]
    raw, hit = bytearray(b"".join(parts)), set()
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(raw))
        raw[at] ^= 1 + rng.randrange(255)
        hit.add(max(k for k in range(12) if starts[k] <= at))
    rows = list(salvage(bytes(raw)))
    covered(raw, rows)
    assert {int(r["record_id"]) for r in rows if r["kind"] == "record" and (r["record_id"] or "").isdigit()} >= set(range(12)) - hit


@pytest.mark.parametrize("damage", ["payload", "version", "cut", "no digest"])
def test_records_within_one_member_are_recovered(damage):
    payloads = [random.Random(k).randbytes(3000) for k in range(6)]
    parts = [record(k, p) for k, p in enumerate(payloads)]
    if damage == "payload":
        parts[2] = parts[2][:-40] + b"#" * 10 + parts[2][-30:]
    elif damage == "version":
        parts[2] = b"XARC" + parts[2][4:]
    raw = gzip.compress(b"".join(parts))
    lost = {2}
    if damage == "cut":
        raw, lost = raw[: len(raw) * 7 // 12], {3, 4, 5}
    elif damage == "no digest":
        plain = [p.replace(b"Digest: sha1:", b"Digest: none:") for p in parts]
        raw, lost = gzip.compress(b"".join(plain))[:-4], set(range(6))  # a member that fails, and records that nothing vouches for
    after = gzip.compress(record(9, b"after"))
    rows = list(salvage(raw + after))
    covered(raw + after, rows)
    assert [(r["record_id"], r["payload"]) for r in rows if r["kind"] == "record"] == [*[(str(k), p) for k, p in enumerate(payloads) if k not in lost], ("9", b"after")]
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["why"]
    if damage in ("payload", "version"):
        assert gaps[0]["inner_start"] == sum(map(len, parts[:2])) and gaps[0]["inner_stop"] == sum(map(len, parts[:3]))


def test_digest_spellings_and_folded_lines():
    payload = b"<p>text</p>"
    hex1 = hashlib.sha1(payload).hexdigest()
    of = lambda digest, more=b"": b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID:\r\n <urn:page:1>\r\n" + more + b"WARC-Payload-Digest: " + digest + b"\r\nContent-Length: 11\r\n\r\n" + payload + b"\r\n\r\n"
    base32 = base64.b32encode(bytes.fromhex(hex1))
    for digest in (b"sha1:" + hex1.encode(), b"sha1:" + hex1.upper().encode(), b"sha1:" + base32, b"SHA1:" + base32.lower(), b"sha-256:" + hashlib.sha256(payload).hexdigest().encode(), b"sha256:" + base64.b32encode(hashlib.sha256(payload).digest()), b"xx:1"):
        rows = list(salvage(of(digest, b"X-Note: a\r\n\t b\r\n")))
        assert [(r["kind"], r.get("record_id"), r.get("payload_digest")) for r in rows] == [("record", "1", hex1)], digest
    for digest in (b"sha1:" + hex1[::-1].encode(), b"sha1:" + base32[::-1], b"md5:" + b"0" * 32, b"sha1:1"):
        assert [(r["kind"], r["why"]) for r in salvage(of(digest))] == [("gap", "payload digest")], digest


def test_empty_file():
    assert list(salvage(b"")) == []


def test_round_trip(spark, tmp_path):
    long = "ü€" * 300
    rows = [(1, "u", long, 0), (5, "u\r\nx", long, 0), (3, None, long, 0), (4, "u", "short", 1), (6, "u", "short", 1), (7, "u", None, 2), (8, "u", "a\r\n\r\nWARC/1.1\r\nb" + "\n" * 999, 3), (8, "u", "a\r\n\r\nWARC/1.1\r\nb" + "\n" * 999, 3), (None, "u", long, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(pages).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = {(k, 1500, sha(long), "response" if k == 5 else "revisit", None if k == 5 else 5) for k in (1, 5, 3, None)}
    want |= {(k, 5, sha("short"), "response", None) for k in (4, 6)} | {(7, 0, sha(""), "response", None), (8, 1015, sha(rows[6][2]), "response", None)}
    assert got == want
    assert archive_pages(pages.limit(0)).count() == 0
    for compressed in (True, False):
        path = str(tmp_path / f"warc{compressed}")
        write_warc(page_records(pages).coalesce(1), path, records_per_file=4, compressed=compressed)
        back = read_warc(spark, path)
        assert back.filter("kind = 'gap'").count() == 0 and back.select("file").distinct().count() == 3
        assert back.count() == 9


def test_query_runs(spark):
    assert op5_warc(spark, "/root/testdata/sf0.001").count() == 50


def test_long_headers_and_members_are_read():
    long = record(0, b"p").replace(b"WARC-Type", b"WARC-Target-URI: data:" + b"x" * 200_000 + b"\r\nWARC-Type")
    large = record(1, bytes((1 << 28) + 1))
    for raw in (long, gzip.compress(long), gzip.compress(large, 1)):
        assert [r["kind"] for r in salvage(raw)] == ["record"]
    assert [r.get("why") for r in salvage(gzip.compress(long), most=1000)] == ["gzip: longer than allowed"]


def test_pages_of_long_urls_stay(spark):
    url, html = "data:" + "x" * 70_000, "<p>" * 1000
    rows = [(1, "u", html), (2, "u", html), (3, url, html), (4, url, "short")]
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, 3000, "revisit", 3), (2, 3000, "revisit", 3), (3, 3000, "response", None), (4, 5, "response", None)}


@pytest.mark.parametrize("compressed", [False, True])
def test_files_are_bounded_by_bytes(spark, tmp_path, compressed):
    sizes = [10] * 40 + [6_000] * 12 + [30_000] * 5 + [200_000]
    rng = random.Random(1)
    pages = spark.createDataFrame([(k, "u", rng.randbytes(n // 2).hex()) for k, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "bounded")
    assert write_warc(page_records(pages).coalesce(1), path, records_per_file=20, bytes_per_file=60_000, compressed=compressed) == len(sizes)
    back = read_warc(spark, path)
    assert back.filter("kind = 'gap'").count() == 0
    held = back.groupBy("file").agg({"*": "count", "stop": "max"}).collect()
    assert sum(r["count(1)"] for r in held) == len(sizes) and max(r["count(1)"] for r in held) <= 20
    assert all(r["max(stop)"] <= 60_000 or r["count(1)"] == 1 for r in held)


@pytest.mark.parametrize("compressed", [False, True])
def test_records_of_any_size_are_computed_once(spark, tmp_path, compressed):
    sizes = [10] * 40 + [6_000] * 12 + [30_000] * 5 + [70_000] * 2 + [200_000]
    random.Random(2).shuffle(sizes)
    pages = spark.createDataFrame([(k, "u", random.Random(k).randbytes(n // 2).hex()) for k, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    records = page_records(pages).coalesce(1)
    path = str(tmp_path / "once")
    assert write_warc(records.mapInArrow(counted, records.schema), path, records_per_file=20, bytes_per_file=60_000, compressed=compressed) == len(sizes)
    assert computed.value == len(sizes)
    back = read_warc(spark, path)
    assert back.filter("kind = 'gap'").count() == 0
    assert sorted(int(r.record_id) for r in back.select("record_id").collect()) == list(range(len(sizes)))
    for name in back.select("file").distinct().collect():
        raw = open(name.file.removeprefix("file:"), "rb").read()
        held = gzip.decompress(raw) if compressed else raw
        n = held.count(b"WARC/1.1\r\n")
        assert 1 <= n <= 20 and (len(held) <= 60_000 or n == 1)


@pytest.mark.parametrize("damage", ["noise", "lost file"])
def test_a_damaged_archive_is_an_error(spark, tmp_path, monkeypatch, damage):
    def damaged(records, path, write=write_warc):
        n = write(records.coalesce(2), path, records_per_file=1)
        first = sorted((tmp_path / "a").glob("part-*"))[0]
        first.with_suffix(".noise").write_bytes(b"noise") if damage == "noise" else first.unlink()
        return n

    monkeypatch.setattr(warc, "write_warc", damaged)
    pages = spark.createDataFrame([(k, "u", str(k)) for k in range(4)], "page_id long, url string, html string")
    with pytest.raises(Corruption):
        archive_pages(pages, path=str(tmp_path / "a"))
