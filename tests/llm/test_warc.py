import base64
import hashlib

import pytest

from rasterlake.llm import common, warc

TYPE = "page_id long, url string, html string, extra string"


def want(rows):
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            raw = (h or "").encode()
            least[raw] = min(least.get(raw, i), i)
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = least.get(raw)
        ref = None if first is None or i == first else first
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", str(ref)))
    return sorted(out)


def got(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id", "url", "html", "'x' extra")
    assert got(warc.round_trip(spark, pages)) == want([tuple(r) for r in pages.collect()])


def test_records_inside_payloads_and_odd_rows(spark):
    trap = warc.record(5, "u", b"payload", warc.digest(b"payload")).decode()
    rows = [
        (1, "a", "same", "x"), (2, "b", "same", "x"), (2, "b", "same", "x"), (None, None, "same", "x"), (3, None, None, "x"), (4, "c\r\nd", "", "x"), (6, "e", trap * 3 + "tail", "x"), (7, "f", trap, "x"),
        (8, "g", "WARC/1.1\r\n" * 99, "x"), (9, "h", "é" * 90000, "x"), (None, None, "alone", "x"),
    ]
    pages = spark.createDataFrame(rows, TYPE)
    assert got(warc.round_trip(spark, pages)) == want(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_many_splits(spark):
    trap = warc.record(5, "u", b"p" * 50, warc.digest(b"p" * 50)).decode()
    rows = [(k, f"u{k}", (trap if k % 3 == 0 else "text ") * (k % 7), "x") for k in range(60)]
    pages = warc.revisits(spark.createDataFrame(rows, TYPE).coalesce(1))
    folder = f"{common.shared_folder(spark)}/splits"
    files = warc.write(pages, folder, roll_bytes=9000)
    assert files.count() > 1
    kept = warc.read(files, folder, split_bytes=700)
    assert sorted(int(r.page) for r in kept.collect()) == list(range(60))


def test_a_broken_chain_is_an_error(spark):
    pages = spark.createDataFrame([(k, "u", f"text {k}" * 50, "x") for k in range(5)], TYPE)
    folder = f"{common.shared_folder(spark)}/broken"
    files = warc.write(warc.revisits(pages.coalesce(1)), folder)
    path = folder.removeprefix("file://") + "/" + files.first().file
    with open(path, "r+b") as f:
        f.seek(0)
        raw = bytearray(f.read())
        at = raw.find(b"WARC/1.1", 300)
        raw[at : at + 4] = b"WORC"
        f.seek(0)
        f.write(raw)
    with pytest.raises(ValueError):
        warc.read(files, folder)


def test_heads_longer_than_what_is_read_past_a_split(spark):
    rows = [(k, "u" * (150_000 if k % 2 else 5), f"text {k}", "x") for k in range(6)]
    folder = f"{common.shared_folder(spark)}/heads"
    files = warc.write(warc.revisits(spark.createDataFrame(rows, TYPE).coalesce(1)), folder)
    assert sorted((int(r.page), r.n) for r in warc.read(files, folder, split_bytes=700).collect()) == [(k, 6) for k in range(6)]


def test_text_ids_with_blanks(spark):
    rows = [(i, "u", f"text {i!r}", "x") for i in ("", " ", "a  b", "a b", " lead", "tail ", "a\r\nb", "100%", "%20", "é:ü")]
    rows += [("z", "u", "text ''", "x"), ("y\t", "u", "text ''", "x")]
    pages = spark.createDataFrame(rows, TYPE.replace("page_id long", "page_id string"))
    assert got(warc.round_trip(spark, pages)) == want(rows)


def test_revisits_name_records(spark):
    """Every record id occurs once, and a revisit's is that of a response with its digest."""
    import re

    rows = [(k, f"u{k}", f"text {k % 4}", "x") for k in range(12)] + [(None, "v", "alone", "x"), (None, "v", "alone too", "x"), (None, "w", "text 1", "x")]
    folder = f"{common.shared_folder(spark)}/names"
    files = warc.write(warc.revisits(spark.createDataFrame(rows, TYPE)), folder)
    raw = b"".join(open(f"{folder.removeprefix('file://')}/{r.file}", "rb").read() for r in files.collect()).decode()
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in re.findall(r"WARC/1\.1\r\n.*?(?=\r\n\r\n)", raw, re.S)]
    ids = [h["WARC-Record-ID"] for h in heads]
    of = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    assert len(heads) == len(rows) == len(set(ids))
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert of[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
