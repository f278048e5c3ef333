import base64
import hashlib

import pytest

from weftline.llm.common import work_dir
from weftline.llm.warc import Settings, read_archives, records, write_archives

SCHEMA = "page_id long, url string, html string, record_type string, digest int"


def test_round_trip(spark):
    pages = [(k, f"http://h{k % 3}.org/{k}\r\n", "<p>" + "text " * (k * 37 % 90)) for k in range(60)]
    pages += [(100, None, None), (101, "u", ""), (102, "u", None), (7, "other", "<p>same id</p>"), (200, "u", "<p>same id</p>"), (None, "n", "<p>no id</p>"), (201, "n", "<p>no id</p>"), (300, "u", "é\r\n\r\n" * 90_000), (8, "u", "twice"), (8, "u", "twice")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], SCHEMA)
    out = work_dir(spark, "w")
    manifest = write_archives(df, out, Settings(file_bytes=4000))
    assert len(manifest["files"]) > 2 and sum(f["records"] for f in manifest["files"]) == len(pages)
    best = {}
    for p, _, h in pages:
        h = h or ""
        best[h] = max(best.get(h, (False, 0)), (p is not None, p or 0))
    want, seen = [], set()
    for p, _, h in pages:
        h = h or ""
        raw = h.encode()
        first = best[h] == (p is not None, p or 0) and (p, h) not in seen
        seen.add((p, h))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[h][1]))
    got = [tuple(r)[:5] for r in read_archives(spark, out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = work_dir(spark, "w")
    assert write_archives(df.orderBy("html"), again, Settings(file_bytes=4000)) == manifest


def test_an_empty_table(spark):
    out = work_dir(spark, "w")
    write_archives(spark.createDataFrame([], SCHEMA), out)
    assert read_archives(spark, out).collect() == []


def test_two_writes_give_the_same_archives(spark):
    df = spark.range(40_000).selectExpr("id as page_id", "concat('http://h', id % 7, '/', id) as url", "repeat('text ', int(id % 11)) as html")
    runs = [write_archives(df.repartition(n), work_dir(spark, "w"), Settings(shard_pages=5000)) for n in (2, 3)]
    assert runs[0] == runs[1] and len(runs[0]["files"]) == 8


def test_a_damaged_archive_raises(spark):
    df = spark.createDataFrame([(k, "u", f"<p>{k}</p>", "x", 1) for k in range(50)], SCHEMA)
    for harm in (lambda raw: raw[:-20], lambda raw: raw[: len(raw) // 2], lambda raw: raw[:-1] + bytes([raw[-1] ^ 1])):
        out = work_dir(spark, "w")
        name = write_archives(df, out)["files"][0]["name"]
        path = f"{out.removeprefix('file://')}/{name}"
        with open(path, "rb") as f:
            raw = f.read()
        with open(path, "wb") as f:
            f.write(harm(raw))
        with pytest.raises(Exception, match="ends within|manifest says|incorrect|invalid"):
            read_archives(spark, out).collect()


def test_whole_members_that_are_missing_raise(spark):
    df = spark.createDataFrame([(k, "u", f"<p>{k}</p>", "x", 1) for k in range(9)], SCHEMA)
    out = work_dir(spark, "w")
    name = write_archives(df, out)["files"][0]["name"]
    path = f"{out.removeprefix('file://')}/{name}"
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw[: raw.rindex(b"\x1f\x8b\x08")])
    with pytest.raises(Exception, match="manifest says"):
        read_archives(spark, out).collect()


def test_dates_from_a_column(spark):
    df = spark.sql("select 1L as page_id, 'u' as url, 'h' as html, timestamp'2024-05-06 07:08:09' as at union all select 2L, 'u', 'i', null")
    out = work_dir(spark, "w")
    name = write_archives(df, out, date_col="at")["files"][0]["name"]
    with open(f"{out.removeprefix('file://')}/{name}", "rb") as f:
        dates = {h["WARC-Record-ID"]: h["WARC-Date"] for h, _ in records(f)}
    assert dates["<urn:page:1>"] == "2024-05-06T07:08:09Z" and dates["<urn:page:2>"] == "2020-01-01T00:00:00Z"
