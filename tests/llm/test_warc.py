"""Archives: exact round trips, the file format read by other means, and one record fetched alone."""

import base64
import hashlib
import io
import random
import uuid
from collections import defaultdict
from pathlib import Path

import pytest
import zstandard

from textloom.llm.warc import Bundle, BundleWriter, archive_index, fetch_records, page_of, parse_record, read_archive, record_id, write_archive

SCHEMA = "page_id long, url string, html string"
FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def plain(pages, least=0):
    groups, out = defaultdict(list), []
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    for page, _, html in pages:
        payload = (html or "").encode()
        keep = min((p for p in groups[payload] if p is not None), default=None)
        revisit = len(payload) >= least and page != keep
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=str)


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (None, "http://c/", "same"), (3, "http://b/", "same"),
    (1, "x y\r\nWARC-Type: badé", "<p>ä \U0001f600</p>"), (2, "u", None), (4, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (7, "u", "y" * 2_000_000),
    (None, None, None), (None, "only", "null ids"), (None, "only", "null ids"), (2**62, "u", "far"), (-4, "u", "far"), (8, "u", "\x00\x01"),
]


@pytest.mark.parametrize(("frame", "frames"), [(1, 1), (300, 3), (1 << 18, 256)])
def test_round_trip(spark, tmp_path, frame, frames):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3).selectExpr("*", "1 as digest", "'x' as payload", "2 as n_bytes", "3 as keep_id")
    write_archive(pages, path, frame=frame, frames=frames)
    back = read_archive(spark, path)
    assert rows(back) == plain(PAGES)
    texts = {((r.page_id, bytes(r.payload).decode()) if r.payload is not None else None) for r in back.collect()} - {None}
    firsts = {(p, (h or "")) for p, _, h in PAGES if (p, "response") in {(r[0], r[3]) for r in plain([x for x in PAGES if (x[2] or "") == (h or "")])}}
    assert texts == firsts
    index = archive_index(spark, path).collect()
    assert len(index) == len(PAGES) + len({r.path for r in index})  # a warcinfo record a bundle
    if frames == 1:
        assert len({r.path for r in index}) == len(list(Path(path).glob("part-*"))) > 10


def test_small_payloads_are_all_responses(spark, tmp_path):
    write_archive(spark.createDataFrame(PAGES, SCHEMA), str(tmp_path / "a"), min_bytes=5)
    assert rows(read_archive(spark, str(tmp_path / "a"))) == plain(PAGES, 5)


def test_any_zstd_reader_reads_a_bundle(spark, tmp_path):
    rng = random.Random(3)
    pages = [(k, f"http://h/{k}", "".join(rng.choices("abc <>\n", k=rng.randrange(3000)))) for k in range(300)]
    write_archive(spark.createDataFrame(pages, SCHEMA).coalesce(1), str(tmp_path / "a"), frame=4096, frames=40)
    found = []
    for part in sorted((tmp_path / "a").glob("part-*")):
        content = part.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        bundle = Bundle(content)
        assert whole == b"".join(bundle.frame(k) for k in range(len(bundle.frames)))
        while whole:  # records follow each other as in any WARC file
            headers, block = parse_record(whole)
            end = whole.index(b"\r\n\r\n") + 4 + len(block)
            assert whole[end : end + 4] == b"\r\n\r\n"
            whole = whole[end + 4 :]
            if headers["warc-type"] != "warcinfo":
                found.append((page_of(headers["warc-record-id"].strip("<>")), block.partition(b"\r\n\r\n")[2].decode()))
        assert sum(f[1] for f in bundle.frames) < len(content)
    assert sorted(p for p, _ in found) == list(range(300))
    kept = {r[0] for r in plain(pages) if r[3] == "response"}
    assert {p: t for p, t in found if p in kept} == {p: t for p, _, t in pages if p in kept}


def test_records_are_fetched_by_identifier(spark, tmp_path):
    pages = [(k, "u", f"text {k}" * 50) for k in range(200)]
    write_archive(spark.createDataFrame(pages, SCHEMA), str(tmp_path / "a"), frame=2000, frames=5)
    names = [(record_id(k, base64.b32encode(hashlib.sha1(pages[k][2].encode()).digest()).decode()),) for k in (0, 17, 199)] + [("urn:x-page:404:none",)]
    got = fetch_records(spark, str(tmp_path / "a"), spark.createDataFrame(names + names[:1], "record_id string")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(k, pages[k][2]) for k in (0, 17, 199)]


def test_damage_is_noticed():
    writer = BundleWriter("1970-01-01T00:00:00Z")
    content = b"".join(writer.add("urn:x-page:1:A", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")) + b"".join(writer.end()) + b"\xb1\xea\x92\x8f"
    assert [name for name, *_ in Bundle(content).index()][1] == "urn:x-page:1:A"
    with pytest.raises(ValueError):
        Bundle(content[:-1])
    with pytest.raises(ValueError):
        Bundle(b"x" + content)
    broken = bytearray(content)
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Bundle(bytes(broken)).frame(0)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    write_archive(spark.createDataFrame([], SCHEMA), path)
    assert read_archive(spark, path).collect() == [] and archive_index(spark, path).collect() == []
