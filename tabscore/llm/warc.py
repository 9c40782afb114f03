"""WARC: records written as bounded segments, read back as a chunked record table.

Writing.  Each page becomes one record: a response with its payload, or a
revisit of the record that first held an equal payload.  A payload longer
than a segment is written as a segmented record (``WARC-Segment-Number``,
``continuation`` records), so no row, buffer or archive line ever exceeds
``SEGMENT_BYTES`` plus headers.  The archives are plain WARC files that
Spark's text sink writes to any file system, one segment a row, the record
separator being the sink's line separator.

Reading.  The text source splits archives at record starts, so a large file is
read by many tasks and none holds more than one segment.  Every segment becomes
a row (record, chunk number, bytes) carrying the digest of the payload up to
and including that chunk.  Records of one segment need no shuffle; only the
segments of longer ones are brought together, in order, and streamed through
one running digest each.

A payload that holds the text of a record start is cut inside it when
written, so no segment contains one and reading cannot be misled.  A record
whose length disagrees with its header raises an error.

Defined results: a null payload is written as empty; payloads under
``REVISIT_BYTES`` are always responses; of rows repeating the smallest id, the
one stored first is the response; a null id ranks last; other columns of the
input, whatever their names, are not written; an empty table gives an empty
archive and no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabscore.llm.common import python_workers, F, T, col, located, materialise, small
from tabscore.session import scratch_path

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 64 * 1024
REVISIT_BYTES = 100
#: Segments of about this many bytes are handed over at a time.
BATCH_BYTES = 4 * 1024 * 1024
HIGHEST = 2**63 - 1

CHUNKS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("chunk", T.LongType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("digest_so_far", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("refers_to", T.LongType()),
    T.StructField("total_bytes", T.LongType()), T.StructField("declared_digest", T.StringType()),
    T.StructField("url", T.StringType())])


def plan(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row per page with its payload and what to write of it: response, or revisit of which page.

    Equal payloads are found on narrow rows (digest, size, id) that combine in
    each task; only digests held more than once are joined back.
    """
    body = F.coalesce(col(payload).cast("binary"), F.lit(b""))
    rows = located(pages, [
        col(ident).cast("long").alias("page_id"), col(url).cast("string").alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size")], "warc-pages")
    first = F.struct(F.coalesce("page_id", F.lit(HIGHEST)).alias("rank"), "file", "pos")
    repeated = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    side, _ = small(materialise(repeated.select("digest", "first"), "warc-repeated"), 120)
    joined = rows.join(side, "digest", "left")
    own = F.col("first").isNull() | ((F.col("first.file") == F.col("file")) & (F.col("first.pos") == F.col("pos")))
    return joined.select(
        record_id("file", "pos").alias("record_id"), "page_id", "url", "payload", "digest", "size",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.nullif(F.col("first.rank"), F.lit(HIGHEST))).alias("refers_to"),
        F.when(~own, record_id("first.file", "first.pos")).alias("refers_to_record"))


def record_id(file: str, pos: str):
    """A urn:uuid derived from where the row is stored."""
    h = F.md5(F.concat_ws(":", F.col(file).cast("string"), F.col(pos).cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def cuts(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes, cut at UTF-8 boundaries and inside every record start (an empty payload: one).

    A start without its line end counts too: at the end of a piece the
    separator that follows would complete it.
    """
    start, n = 0, len(payload)
    marks, at = [], -1
    data = payload.obj
    while (at := data.find(VERSION.rstrip(), at + 1)) >= 0:
        marks.append(at + 4)
    marks.append(n)
    for mark in marks:
        while start < mark or (start == 0 and n == 0):
            end = min(start + size, mark)
            while end < mark and end > start + 1 and data[end] & 0xC0 == 0x80 and start + size - end < 4:
                end -= 1
            yield payload[start:end]
            start = end
            if n == 0:
                return


def field(name: str, value) -> bytes:
    """One header line; control characters and non-ASCII in the value are percent-encoded."""
    if value is None:
        return b""
    out = "".join(c if " " <= c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace"))
                  for c in str(value))
    return f"{name}: {out}\r\n".encode()


def segments(r: dict, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The bytes of a record's segments, each without the separator that follows it."""
    common = field("WARC-Date", DATE) + field("WARC-Target-URI", r["url"]) + field("X-Page-ID", r["page_id"])
    if r["record_type"] == "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
        yield (VERSION + field("WARC-Type", "revisit") + field("WARC-Record-ID", f"<{r['record_id']}>") + common
               + field("WARC-Profile", REVISIT_PROFILE) + field("WARC-Refers-To", f"<{r['refers_to_record']}>")
               + field("X-Refers-To-Page-ID", r["refers_to"]) + field("X-Payload-Length", r["size"])
               + field("WARC-Payload-Digest", f"sha256:{r['digest']}")
               + field("Content-Type", "application/http; msgtype=response")
               + field("Content-Length", len(block)) + b"\r\n" + block)
        return
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            + field("Content-Length", r["size"]) + b"\r\n")
    running = hashlib.sha256()
    pieces = cuts(memoryview(r["payload"]), size)
    piece, number = next(pieces), 1
    while piece is not None:
        running.update(piece)
        after = next(pieces, None)
        first, last = number == 1, after is None
        head = VERSION + field("WARC-Type", "response" if first else "continuation")
        head += field("WARC-Record-ID", f"<{r['record_id']}>" if first else f"<{r['record_id']}-{number}>")
        head += common
        if not (first and last):
            head += field("WARC-Segment-Number", number)
            if not first:
                head += field("WARC-Segment-Origin-ID", f"<{r['record_id']}>")
            if last:
                head += field("WARC-Segment-Total-Length", len(http) + r["size"])
        if first:
            head += field("WARC-Payload-Digest", f"sha256:{r['digest']}")
            head += field("Content-Type", "application/http; msgtype=response")
        block = (http if first else b"") + bytes(piece)
        yield head + field("Content-Length", len(block)) + b"\r\n" + block
        piece, number = after, number + 1
    if running.hexdigest() != r["digest"]:
        raise ValueError(f"{r['record_id']}: written bytes do not match the payload digest")


def write(planned: DataFrame, path: str, size: int = SEGMENT_BYTES) -> None:
    """Write the planned records as WARC files below ``path``."""
    python_workers(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            names = b.schema.names
            for k in range(b.num_rows):
                for s in segments({n: b.column(i)[k].as_py() for i, n in enumerate(names)}, size):
                    out.append(s)
                    held += len(s)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string(), safe=False)], ["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string(), safe=False)], ["value"])

    planned.mapInArrow(run, "value string").write.option("lineSep", END).text(path)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record as the source delivers it."""
    if record.startswith(VERSION):
        record = record[len(VERSION):]
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b": ")
        fields[name.decode().lower()] = value.decode()
    n = int(fields["content-length"])
    if len(rest) < n or rest[n:].strip(b"\r\n"):
        raise ValueError(f"{fields.get('warc-record-id')}: {len(rest)} bytes follow a header that says {n}")
    return fields, rest[:n]


def chunk_row(record: bytes) -> dict:
    """One segment as a chunk row without its running digest."""
    f, block = parse(record)
    kind, number = f["warc-type"], int(f.get("warc-segment-number", 1))
    page, refers = f.get("x-page-id"), f.get("x-refers-to-page-id")
    payload = block.partition(b"\r\n\r\n")[2] if number == 1 else block
    total = None
    if kind == "revisit":
        payload, total = b"", int(f["x-payload-length"])
    return {"record_id": f.get("warc-segment-origin-id", f["warc-record-id"])[1:-1], "chunk": number,
            "n_bytes": len(payload), "payload": payload, "digest_so_far": None,
            "record_type": "response" if kind == "continuation" else kind,
            "page_id": None if page is None else int(page), "refers_to": None if refers is None else int(refers),
            "total_bytes": total, "declared_digest": f.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "url": f.get("warc-target-uri")}


def batches_of(rows: Iterator[dict], names: list[str], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r["payload"] or b"") + 300
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], types[n]) for n in names], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], types[n]) for n in names], names)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_TYPES = {f.name: _ARROW[f.dataType.simpleString()] for f in CHUNKS.fields}


def chunk_table(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archives below ``path`` as chunk rows with running digests (``with_payload=False``: digests without the bytes)."""
    python_workers(spark)
    lines = spark.read.option("lineSep", END + VERSION.decode()).text(path).select(
        F.col("value").cast("binary").alias("value"), F.instr("value", "WARC-Segment-Number: ").alias("many"))
    names = [f.name for f in CHUNKS.fields]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for v in b.column(0):
                yield chunk_row(v.as_py())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digested():
            for r in rows_of(batches):
                r["digest_so_far"] = (r["declared_digest"] if r["record_type"] == "revisit"
                                      else hashlib.sha256(r["payload"]).hexdigest())
                yield r if with_payload else r | {"payload": None}
        yield from batches_of(digested(), names, _TYPES)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows_of(batches), names, _TYPES)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digested():
            current, digest, expected = None, None, 1
            for b in batches:
                for r in b.to_pylist():
                    if r["record_id"] != current:
                        current, digest, expected = r["record_id"], hashlib.sha256(), 1
                    if r["chunk"] != expected:
                        raise ValueError(f"{current}: segment {expected} is missing")
                    expected += 1
                    digest.update(r["payload"])
                    r["digest_so_far"] = (r["declared_digest"] if r["record_type"] == "revisit"
                                          else digest.copy().hexdigest())
                    yield r if with_payload else r | {"payload": None}
        yield from batches_of(digested(), names, _TYPES)

    single = lines.where("many = 0").select("value").mapInArrow(whole, CHUNKS)
    several = lines.where("many > 0").select("value").mapInArrow(parts, CHUNKS)
    several = several.repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(running, CHUNKS)
    return single.unionByName(several)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its page, size, digest, type and what it revisits.

    Narrow: the sizes add up and the digest is that of the last chunk.
    """
    last = F.struct("chunk", "digest_so_far", "record_type", "page_id", "refers_to", "total_bytes")
    one = chunks.groupBy("record_id").agg(F.sum("n_bytes").alias("read"), F.max(last).alias("last"))
    return one.select("record_id", "last.page_id", F.coalesce("last.total_bytes", "read").alias("payload_bytes"),
                      F.col("last.digest_so_far").alias("payload_digest"), "last.record_type", "last.refers_to")


def archive(pages: DataFrame, path: str | None = None, ident: str = "page_id", url: str = "url",
            payload: str = "html") -> str:
    """Plan and write ``pages``; returns the archives' path."""
    path = path or os.path.join(scratch_path(pages.sparkSession, "warc"), "archives")
    write(plan(pages, ident, url, payload), path)
    return path
