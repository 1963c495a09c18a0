"""WARC archives: written once, indexed first, read back by coalesced byte ranges.

Writing: records of equal payloads of at least MIN_REVISIT bytes are one response and revisits of it; the decision comes from
an aggregation by payload digest over narrow rows, and only then does each page's record go to a file. Each record is a gzip
member of its own, as the format asks, and each written record gives an index row: path, offset, length, URL, digest.
Reading: any selection of index rows is dealt out by file and stretch of it, as many tasks as the selected bytes call for, sorted by
offset, and neighbouring byte ranges are fetched together.

A null payload is empty, a null URL is the empty URL. Of equal payloads the row of the smallest id is the response; rows that
repeat both id and payload are all responses if theirs is the smallest id. A null id is larger than any. An empty table gives
no file and an empty index. Extra columns are ignored. A payload of any
length is one record, held whole by one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, dealt_join, filesystem, fresh, slack, written

MIN_REVISIT = 100
#: A file is closed once it holds so many bytes.
FILE_BYTES = 1 << 27
#: Byte ranges at most so far apart are fetched together, up to so many bytes at once.
GAP_BYTES, RANGE_BYTES = 1 << 16, 1 << 23
#: Bytes of archives that a task reads back, about.
TASK_BYTES = 1 << 26
INDEX = "page_id long, url string, path string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    """A record's URN, alike whenever a page of this id and payload is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record; refers_to makes it a revisit, without the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c for c in url if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        **({} if refers_to is None else {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload, payload length as the HTTP header states it) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, stated


def ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(offset, length, positions of the spans inside) for (offset, length) spans sorted by offset."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset <= out[-1][0] + out[-1][1] + GAP_BYTES and offset + length - out[-1][0] <= RANGE_BYTES:
            begin, held, inside = out[-1]
            inside.append(i)
            out[-1] = (begin, max(held, offset + length - begin), inside)
        else:
            out.append((offset, length, [i]))
    return out


def _decided(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """pages with digest and refers_to; only narrow rows meet by digest, whole pages are joined by id and digest."""
    payload = F.coalesce(column(html_col), F.lit("")).cast("binary")
    rows = pages.select(column(id_col).cast("long").alias("page_id"), F.coalesce(column(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    revisit = dealt_join(large.select("page_id", "digest"), first.drop("n"), ["digest"]).where("NOT page_id <=> first_id").distinct()
    keyed = revisit.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first_id").alias("refers_to"))
    return rows.join(keyed, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as Python values, a few at a time."""
    for i in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", where: str | None = None) -> DataFrame:
    """Writes the archives; returns their index (INDEX), a table in the shared folder.

    A task writes under a name of its own and then renames, so a task that runs again or twice leaves the same files.
    """
    slack(pages, [id_col, url_col, html_col], "write_warc")
    where = where or fresh(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = filesystem(where)
        fs.create_dir(folder)
        out, at, part, rows = None, 0, 0, []

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temp, final)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
        for batch in batches:
            for page_id, url, payload, digest, refers_to in _rows(batch):
                if out is None:
                    name = f"{task.partitionId():06d}-{part:04d}"
                    final, temp, at, rows = f"{folder}/{name}.warc.gz", f"{folder}/_{name}.{task.taskAttemptId()}.tmp", 0, []
                    out, part = fs.open_output_stream(temp, compression=None), part + 1
                digest = digest.hex()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = pack.compress(build_record(page_id, url, payload, digest, refers_to)) + pack.flush()
                out.write(raw)
                rows.append((page_id, url, f"{where}/{name}.warc.gz", at, len(raw), digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                at += len(raw)
                if at >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(_decided(pages, id_col, url_col, html_col).mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows, each parsed from its file and checked against its digest.

    page_id, payload_bytes, payload_digest, record_type, refers_to and, if with_payload, the payload (null for a revisit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]
        for path, spans in _by_file(batches):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as source:
                for begin, length, inside in ranges(spans):
                    source.seek(begin)
                    raw, rows = source.read(length), []
                    for i in inside:
                        o, n = spans[i]
                        headers, payload, stated = parse_record(zlib.decompress(raw[o - begin : o - begin + n], 31))
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {o}: the payload differs from its digest")
                        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        row = (int(page) if page else None, stated, digest, kind, int(refers) if refers else None, payload if kind == "response" else None)
                        rows.append(row[: len(names)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # The rows are few bytes and stand for many: tasks are counted by the archives' bytes, and a file is dealt out in stretches.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    stretch = F.floor(F.col("offset") / RANGE_BYTES)
    dealt = index.select("path", "offset", "length").repartition(tasks, "path", stretch).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, schema)


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(path, spans) of neighbouring rows of one path; a path may come again in the next batch."""
    for batch in batches:
        path, spans = None, []
        for p, o, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if p != path and spans:
                yield path, spans
                spans = []
            path = p
            spans.append((o, n))
        if spans:
            yield path, spans
