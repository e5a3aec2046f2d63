"""WARC archives: writing with revisit records, and parallel reading by boundary-chain verification.

Writing: each task appends records (``response``, or ``revisit`` for a payload that another record holds) to archive files in a
shared folder, closed at ``ROLL_BYTES``. Reading: files are cut into splits. A task emits, for every record-like start in its
split, the offset of its successor. Pointer jumping follows these from the file's start: first inside each split (numpy), then
over the splits' entries and exits (joins that double the distance each round); only records reached are kept, so that record
starts inside payloads are rejected.

Archives are reached through Arrow's file systems, by the folder's own scheme. A response's record id is made from its page and
payload's digest, so that a revisit names it (``WARC-Refers-To``) wherever it was written; other revisits' ids are random.

Defined cases: a null html is an empty payload; null page ids and urls are left out of the headers, a null id is never the
smallest; text ids keep their blanks (escaped in the headers), urls' line breaks become blanks; records with equal ids and
payloads are all responses, with one record id, if their id is the smallest; a truncated or corrupt chain raises ``ValueError``;
an empty table writes no archive and reads no record; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

MAGIC = b"WARC/1.1\r\n"
ROLL_BYTES = 64_000_000
SPLIT_BYTES = 8_000_000
HEAD_BYTES = 65_536
MIN_REVISIT = 0
#: Copied payloads whose digests are sent to all tasks; beyond that a join by shuffle takes over.
BROADCAST_ROWS = 50_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(raw: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id, sha: str) -> str:
    """The id of a page's response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{sha}')}>"


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None) -> bytes:
    """The bytes of one record; with ``refers_to`` a revisit, which leaves the payload out."""
    line = lambda s: " ".join(s.split())
    http = _HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    # rows without an id are told apart by nothing
    own = record_id(page_id, sha) if refers_to is None and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [
        MAGIC.decode().rstrip(), f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {own}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {quote(str(page_id))}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"X-Refers-To-Page: {quote(str(refers_to))}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Headers of a record-like start at ``at`` and where its block begins; None if it is no full record head."""
    end = raw.find(b"\r\n\r\n", at)
    if end < 0 or not raw.startswith(MAGIC, at):
        return None
    fields = {}
    for text in raw[at + len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = text.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as archives below ``folder``; returns ``file`` and ``size`` of each, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, size, n = None, 0, 0
        for batch in batches:
            ids, urls, pages_, refers = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                html = pages_[i].as_py()
                payload = html.encode("utf-8", "surrogatepass") if html is not None else b""
                raw = record(ids[i].as_py(), urls[i].as_py(), payload, digest(payload), refers[i].as_py())
                if out is None:
                    file, size = f"{name}-{n}.warc", 0
                    out = system.open_output_stream(f"{base}/{file}")
                    n += 1
                out.write(raw)
                size += len(raw)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size])], names=["file", "size"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size])], names=["file", "size"])

    made = pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, size long")
    return stored(made, "warc-files")  # only files of attempts that were committed are listed


def candidates(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record-like start: its file, split, offset, successor's offset, headers and payload's digest."""
    splits = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / split_bytes).cast("long"))).alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, size, split in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                start, stop = split * split_bytes, min((split + 1) * split_bytes, size)
                with system.open_input_file(f"{base}/{file}") as f:
                    raw = f.read_at(min(stop + HEAD_BYTES, size) - start, start)
                    rows = []
                    at = raw.find(MAGIC)
                    while 0 <= at < stop - start:
                        # a head that goes on beyond what was read: it ends with its record at the latest
                        while raw.find(b"\r\n\r\n", at) < 0 and start + len(raw) < size:
                            raw += f.read_at(min(len(raw), size - start - len(raw)), start + len(raw))
                        got = parse_head(raw, at)
                        if got:
                            fields, body = got
                            end = body + int(fields["content-length"])
                            after = start + end + 4
                            if after <= size:
                                block = raw[body:end] if end <= len(raw) else f.read_at(end - body, start + body)
                                cut = block.find(b"\r\n\r\n")
                                payload = block[cut + 4 :] if cut >= 0 else block
                                full = fields["warc-type"] != "revisit"
                                sha = digest(payload) if full else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                                n = len(payload) if full else int(fields.get("x-payload-length", 0))
                                page, ref = (unquote(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page"))
                                rows.append((start + at, after, page, n, sha, fields["warc-type"], ref))
                        at = raw.find(MAGIC, at + 1)
                if rows:
                    offset, after, page, n, sha, kind, ref = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(rows)), pa.array([split] * len(rows)), pa.array([size] * len(rows)), pa.array(offset), pa.array(after), pa.array(page, pa.string()), pa.array(n), pa.array(sha), pa.array(kind), pa.array(ref, pa.string())],
                        names=["file", "split", "size", "offset", "after", "page", "n", "sha", "kind", "ref"],
                    )

    # one task reads a few splits; they are dealt evenly
    schema = "file string, split long, size long, offset long, after long, page string, n long, sha string, kind string, ref string"
    return splits.repartition("file", "split").mapInArrow(run, schema)


def _jumps(links: DataFrame) -> DataFrame:
    """Per split and start in it: where the chain from there leaves the split (pointer jumping in numpy)."""

    def run(rows):
        rows = rows.sort_by("offset")
        offset, after = rows["offset"].to_numpy(), rows["after"].to_numpy()
        n = len(offset)
        to = np.searchsorted(offset, after)
        inside = (to < n) & (offset[np.minimum(to, n - 1)] == after)
        jump = np.append(np.where(inside, to, n + np.arange(n)), n + np.arange(n))  # n + i: the end at i
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        last = jump[:n] - n
        return pa.table({"file": rows["file"], "split": rows["split"], "offset": rows["offset"], "exit": pa.array(after[last])})

    return links.groupBy("file", "split").applyInArrow(run, "file string, split long, offset long, exit long")


def reachable(found: DataFrame) -> DataFrame:
    """``file`` and ``offset`` of the records on the chains that begin at the files' starts."""
    jumps = stored(_jumps(found.select("file", "split", "offset", "after")), "warc-jumps")
    # a split's entry is reached from the chain's entry into an earlier one: doubling over splits
    step = jumps.select("file", "offset", F.col("exit").alias("to"))
    reached = stored(jumps.where("offset = 0").select("file", "offset"), "warc-reached")
    size = reached.count()
    while True:
        more = reached.join(step, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = stored(reached.unionByName(more).distinct(), "warc-reached")
        now = reached.count()
        if now == size:
            break
        size = now
        second = step.withColumnsRenamed({"offset": "at", "to": "offset"}).join(step, ["file", "offset"], "left")
        step = stored(second.select("file", F.col("at").alias("offset"), F.coalesce("to", "offset").alias("to")), "warc-steps")
    # entries of the doubled walk; the ones between are walked split by split
    return reached


def chain(found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The candidates that are records: those on their file's chain. Raises ``ValueError`` if a chain stops short of its file's end."""
    entries = reachable(found)

    def run(left, right):
        left = left.sort_by("offset")
        offset, after = left["offset"].to_numpy(), left["after"].to_numpy()
        keep = np.zeros(len(offset), bool)
        for start in right["offset"].to_numpy():
            at = int(np.searchsorted(offset, start))
            while at < len(offset) and offset[at] == start and not keep[at]:
                keep[at] = True
                start = after[at]
                at = int(np.searchsorted(offset, start))
        return left.filter(pa.array(keep))

    marked = entries.withColumn("split", F.floor(F.col("offset") / split_bytes).cast("long"))
    columns = "file string, split long, size long, offset long, after long, page string, n long, sha string, kind string, ref string"
    kept = found.groupBy("file", "split").cogroup(marked.groupBy("file", "split")).applyInArrow(run, columns)
    return kept


def read(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives, verified by their chains: page, payload's size and digest, kind, reference."""
    found = stored(candidates(files, folder, split_bytes), "warc-candidates")
    kept = stored(chain(found, split_bytes), "warc-records")
    ends = kept.groupBy("file").agg(F.max("after").alias("end"))
    short = files.join(ends, "file", "left").where(F.coalesce("end", F.lit(0)) != F.col("size"))
    if not short.isEmpty():
        raise ValueError("an archive's record chain stops before its end")
    return kept


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of ``least`` bytes or more the smallest page id is referred to."""
    payload: Column = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("key"), F.octet_length(payload).alias("n"))
    copies = keyed.where(F.col("n") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "first")
    copies = stored(copies, "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    ref = F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))
    return keyed.join(copies, "key", "left").select("page_id", "url", "html", ref.alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back."""
    folder = folder or fresh(spark, "warc")
    id_type = dict(pages.dtypes)["page_id"]
    records = read(write(revisits(pages), folder), folder)
    return records.select(
        F.col("page").cast(id_type).alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("ref").cast(id_type).alias("refers_to")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All ``pages``."""
    return round_trip(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
b AS (SELECT *, list_transform(range(0, 4), lambda k: ('0x' || x[k * 10 + 1 : k * 10 + 10])::BIGINT) AS words FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((words[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN f IS NULL OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f IS NULL OR page_id = f THEN NULL ELSE f END AS refers_to FROM b
"""
