"""WARC archives: writing with revisits and segments, reading with segment reassembly.

``write`` is plain DataFrame code: records are text (payloads are UTF-8), the text sink writes
them, and its line separator is the two line ends that close a WARC record.  Of records with equal
payloads of at least ``LEAST_BYTES`` only the one with the largest key is a response, the others are revisits of
it.  Bodies are chunked; blocks of over ``SEGMENT_CHARS`` characters go into a first record and
continuation records.

``read`` parses whole archive files, groups the continuation records by the identifier of their
origin, orders them by segment number, verifies the total length, decodes the chunked framing and
checks the digest.  Anything that doesn't fit is named in ``problem``; no record is dropped.

A null html is an empty payload; a null url has no target header; repeated rows give records of their own.  A very long text is
cut like any other.  An empty table gives no records; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import scratch_path

LEAST_BYTES = 1000
CHUNK_CHARS = 4096
SEGMENT_CHARS = 16384
#: Pieces that a text is cut into at most, so that cutting stays linear in its length.
MOST_PIECES = 64
END = "\r\n"
#: Records of an archive file; a record's block has SEGMENT_CHARS characters at most, or a MOST_PIECES-th of a very long text.
FILE_RECORDS = 10_000
PARSED = "record_id string, type string, origin string, segment int, total_length long, page_id long, target_uri string, refers_to long, digest string, payload_bytes long, block binary, problem string"


def _let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _cut(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters, or more if it's very long; empty text: no piece."""

    def pieces(t: Column, length: Column) -> Column:
        n = F.greatest(F.lit(size), F.ceil(length / MOST_PIECES).cast("int"))
        count = F.ceil(length / n).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * n + 1, n))).otherwise(F.array().cast("array<string>"))

    return _let(text, lambda t: _let(F.length(t), lambda length: pieces(t, length)))


def plan(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every row."""
    p = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    copies = p.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("payload_digest").alias("its")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(copies, F.col("payload_digest") == F.col("its"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str | None = None, date: str = "2026-01-01T00:00:00Z", **columns: str) -> str:
    """Write the archives; returns the folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    p = plan(pages, **columns).withColumn("id", F.monotonically_increasing_id())
    chunks = F.transform(_cut(F.col("payload"), CHUNK_CHARS), lambda x: F.concat(F.lower(F.hex(F.octet_length(x).cast("long"))), F.lit(END), x, F.lit(END)))
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}")
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.concat(head, F.array_join(chunks, ""), F.lit(f"0{END}{END}")))
    cut = lambda b: F.when(b != "", _cut(b, SEGMENT_CHARS)).otherwise(F.array(F.lit("")))
    p = p.withColumn("made", _let(block, lambda b: F.struct(F.octet_length(b).alias("total"), cut(b).alias("parts")))).drop("payload")
    p = p.select("*", F.col("made.total").alias("total"), F.size("made.parts").alias("many"), F.posexplode("made.parts").alias("at", "part")).drop("made")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        said = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))
        return F.coalesce(said if when is None else F.when(when, said), F.lit(""))

    first, own = F.col("at") == 0, F.concat(F.lit("<urn:hirelane:"), F.col("id"), F.lit("-"), F.col("at") + 1, F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", own),
        F.lit(f"WARC-Date: {date}{END}"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")),
        line("WARC-Page-ID", F.col("page_id"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), first),
        line("WARC-Payload-Bytes", F.col("payload_bytes"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("record_type") == "revisit"),
        line("WARC-Refers-To-Page", F.col("refers_to")),
        line("WARC-Segment-Number", F.col("at") + 1, F.col("many") > 1),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:hirelane:"), F.col("id"), F.lit("-1>")), ~first),
        line("WARC-Segment-Total-Length", F.col("total"), (F.col("many") > 1) & (F.col("at") + 1 == F.col("many"))),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", F.octet_length("part")),
        F.lit(END),
        F.col("part"),
    )
    p.select(record.alias("record")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers in lower case, block, problem) of every record of an archive file's plain bytes.

    Bytes that aren't a record come as one without headers, up to where the next record begins.
    """
    at = 0
    while at < len(raw):
        if raw.startswith(b"\r\n", at):
            at += 2
            continue
        stop = raw.find(b"\r\n\r\n", at)
        head, size = {}, ""
        if stop >= 0 and raw.startswith(b"WARC/", at):
            lines = raw[at:stop].decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = head.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,18}", size):
            end = raw.find(b"\r\nWARC/", at + 1)
            end = len(raw) if end < 0 else end
            yield head, raw[at:end], f"no WARC record at byte {at}"
            at = end
            continue
        block = raw[stop + 4 : stop + 4 + int(size)]
        yield head, block, None if len(block) == int(size) else f"the record ends early, {len(block)} of {size} bytes"
        at = stop + 4 + int(size)


def gunzip(raw: bytes) -> tuple[bytes, str | None]:
    """(plain bytes, problem) of a gzip file with any number of members; other bytes come back unchanged."""
    out, at, view = [], 0, memoryview(raw)
    while view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            while not z.eof and at < len(raw):
                piece = view[at : at + (1 << 20)]
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error as e:
            return b"".join(out), f"the file can't be decompressed: {e}"
        if not z.eof:
            return b"".join(out), "the compressed file ends early"
    return b"".join([*out, view[at:]]), None


def dechunk(body: bytes) -> bytes:
    """Body of a chunked transfer, extensions and trailers ignored."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunked body ends early")
        size = int(body[at:stop].split(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk's size is negative")
        if not size:
            return b"".join(out)
        if len(body) < stop + 4 + size:
            raise ValueError("chunk ends early")
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size


def payload(block: bytes) -> bytes:
    """Decoded payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def parse(spark: SparkSession, path: str) -> DataFrame:
    """PARSED rows of all archive files in a folder; problem tells what of a file or record can't be read."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if re.fullmatch(r"-?[0-9]{1,18}", x or "") else None
        for b in batches:
            for raw in b.column(0):
                rows, held = [], 0
                plain, broken = gunzip(raw.as_py())
                every = records(plain)
                for h, block, problem in itertools.chain(every, [({}, b"", broken)] if broken else ()):
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-segment-origin-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), number(h.get("warc-page-id")), h.get("warc-target-uri"), number(h.get("warc-refers-to-page")), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, number(h.get("warc-payload-bytes")), block, problem))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, PARSED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, payload, problem) of every record that isn't a continuation."""
    rows = parse(spark, path)
    segmented = rows.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    ahead = [c for c in rows.columns if c not in ("record_id", "origin", "segment", "total_length", "block", "problem")]
    # A group is one record's segments, never more.
    joined = segmented.groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ahead if c != "type"],
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.max("total_length").alias("total_length"),
        F.max("problem").alias("problem"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = joined.withColumns({
        "gap": ~F.forall(F.transform("parts", lambda x, i: x["segment"] == i + 1), lambda x: x),
        "block": F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"])),
        "segmented": F.lit(True),
    })
    single = rows.where("segment is null").withColumns({"gap": F.lit(False), "segmented": F.lit(False)})
    cols = [*ahead, "total_length", "gap", "segmented", "block", "problem"]
    out = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.to_pylist():
                body, problem = None, r["problem"]
                size, digest = r["payload_bytes"], r["digest"]
                if problem:
                    pass
                elif r["gap"] or (r["segmented"] and r["type"] is None):
                    problem = "a segment is missing"
                elif r["segmented"] and r["total_length"] != len(r["block"]):
                    problem = f"total length {r['total_length']}, found {len(r['block'])}"
                elif r["type"] != "revisit":
                    try:
                        body = payload(r["block"])
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                        if r["digest"] not in (None, digest):
                            problem = "the digest differs"
                    except ValueError as e:
                        problem = str(e)
                made.append((r["page_id"], r["target_uri"], r["type"], r["refers_to"], size, digest, body, problem))
            cs = list(zip(*made, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cs, types, strict=True)], [c.split()[0] for c in out.split(", ")])

    return single.select(cols).unionByName(joined.select(cols)).mapInArrow(run, out)
