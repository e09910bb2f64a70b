"""WARC archives: writing with revisit records, and a reader that salvages.

Writing is DataFrame work: pages with equal payloads are one response (the
largest page_id) and revisits; each row becomes one record, and Spark's text
writer writes the archives to any store it knows: with gzip, each record is a
member of its own, compressed in the task, and the line separator is an empty
member; plain records have the record end as line separator. Reading takes whole files
through Spark's binary reader; a file is as large as its writer made it
(here one output task's share), and is parsed in one pass.

The reader checks member streams, version lines, lengths, record ends and
payload digests. After a failed check it looks for the next gzip member or
version line, goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common

END = "\r\n\r\n"
URN = "urn:ledgerloom:page:"
VERSION = re.compile(rb"WARC/\d\.\d+\r\n")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("file string, position long, length long, kind string, reason string, record_type string, record_id string, "
          "target string, refers_to string, payload_digest string, payload_bytes long, payload binary")


# ---------------------------------------------------------------- writing

def base32_sha1(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a string: five hex digits make four base32 digits."""
    h = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to. The digests' largest ids are found before the join, so a payload
    held by a third of all pages is one row a task there; they are written, so
    the join has shuffles of its own and that payload's rows can be split."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    top = p.groupBy("payload_digest").agg(F.max("page_id").alias("top")).withColumnRenamed("payload_digest", "d")
    j = p.join(common.staged(top, "digests"), F.col("payload_digest") == F.col("d")).drop("d")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return j.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("top"))).drop("top")


def records(typed: DataFrame) -> DataFrame:
    """One record per row, without the record end."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
                                 line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"))
    return typed.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, *, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``.

    One record per row. A null html is an empty payload; rows that share page
    id and payload with the largest are all responses; a null page_id never
    is the response others refer to and is a revisit where its payload has
    one; a null or missing url is left out; other columns are ignored. An
    empty table writes no records. With gzip a damaged member costs its own
    record only.
    """
    rows = records(with_types(pages, least_bytes))
    if compression.lower() != "gzip":
        rows.write.option("lineSep", END).option("compression", compression).text(path)
        return
    # the writer copies a string's bytes as they are, and the separator's in the encoding named
    zipped = rows.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    zipped.write.option("lineSep", _member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)
    _gz_names(pages.sparkSession, path)


def _member(raw: bytes) -> bytes:
    return gzip.compress(raw, 6, mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [_member(v.as_py().encode() + END.encode()) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])


def _gz_names(spark: SparkSession, path: str) -> None:
    """The writer took the members for plain text and named the files so."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    folder = of(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(folder):
        if f.getPath().getName().endswith(".txt"):
            store.rename(f.getPath(), of(f.getPath().toString() + ".gz"))


# ---------------------------------------------------------------- reading

def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds as far as it is sound, the end of
    what was read, and whether the member is whole."""
    z, out, step = zlib.decompressobj(31), [], 65536
    pos = at
    while pos < len(data) and not z.eof:
        chunk, before = data[pos:pos + step], z.copy()
        try:
            out.append(z.decompress(chunk))
        except zlib.error:  # what came out before the flaw is lost: again in smaller pieces
            z = before
            if step > 1:
                step //= 16
                continue
            try:
                while piece := z.decompress(chunk, 1):
                    out.append(piece)
                    chunk = z.unconsumed_tail
            except zlib.error:
                pass
            return b"".join(out), pos, False
        pos += len(chunk)
    return b"".join(out), pos - len(z.unused_data), z.eof


def _begins(data: bytes, at: int) -> bool:
    """Is there a gzip member at ``at``: it can be read a while, or at least a version line?"""
    part = data[at:at + 4096]
    try:
        return bool(zlib.decompressobj(31).decompress(part))
    except zlib.error:
        return bool(VERSION.match(_inflate(part, 0)[0]))


def _plain_after(data: bytes, pos: int, flaw: int, out: bytes) -> int:
    """The first version line after ``pos`` that is not in ``out`` already, as
    a block that holds its bytes as they are has it there; -1 if there is none."""
    seen = 0
    for m in VERSION.finditer(data, pos + 1):
        x = m.start()
        # the bytes after the line, short of a checksum, or those before: a block's own header can lie on one side
        sides = [(x, min(x + 200, flaw - 16)), (max(pos, x - 100), x + 20)]
        places = [out.find(data[a:b], seen) for a, b in sides if b <= flaw and b - a >= 64]
        if max(places, default=-1) < 0:
            return x
        seen = min(k for k in places if k >= 0) + 1
    return -1


def _headers(raw: bytes) -> dict[str, str] | None:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _records(buf: bytes, whole: bool) -> Iterator[tuple[int, int, str, dict | None, bytes]]:
    """(start, end, failed check or "", headers, block) over plain bytes. ``whole``:
    nothing is missing after the last byte."""
    pos = 0
    while pos < len(buf):
        m = VERSION.match(buf, pos)
        fail, head, block, end = "", None, b"", pos
        if not m:
            fail = "no version line"
        else:
            stop = buf.find(b"\r\n\r\n", m.end())
            head = _headers(buf[m.end():stop]) if stop >= 0 else None
            size = head.get("content-length", "") if head else ""
            if head is None:
                fail = "bad headers"
            elif not re.fullmatch("[0-9]+", size):
                fail = "bad length"
            else:
                end = stop + 4 + int(size)
                block = buf[stop + 4:end]
                if end > len(buf):
                    fail = "truncated"
                elif buf[end:end + 4] != b"\r\n\r\n" and not (whole and end == len(buf)):
                    fail = "no record end"
                else:
                    said = re.fullmatch("sha1:([A-Z2-7]{32})", head.get("warc-payload-digest", ""))
                    if said and head.get("warc-type") == "response" and said[1] != base64.b32encode(hashlib.sha1(block).digest()).decode():
                        fail = "digest"
        if not fail:
            yield pos, min(end + 4, len(buf)), "", head, block
            pos = end + 4
            continue
        nxt = VERSION.search(buf, m.end() if m else pos + 1)
        stop = nxt.start() if nxt else len(buf)
        yield pos, stop, fail, None, b""
        pos = stop


def parse(data: bytes) -> Iterator[tuple[int, int, str, dict | None, bytes]]:
    """Records and gaps of one archive: (start, end, failed check or "",
    headers, block). Places are bytes of the file; for a record inside a gzip
    member they are the member's."""
    pos = 0
    while pos < len(data):
        if data[pos:pos + 3] == MAGIC:
            out, end, sound = _inflate(data, pos)
            if not sound:  # the next member that really is one
                nxt = data.find(MAGIC, pos + 1)
                while nxt >= 0 and not _begins(data, nxt):
                    nxt = data.find(MAGIC, nxt + 1)
                stops = [x for x in (nxt, _plain_after(data, pos, end, out)) if x >= 0]
                end = min(stops, default=len(data))
            for _, _, fail, head, block in _records(out, sound):
                yield pos, end, fail, head, block
            if not sound:
                yield pos, end, "broken member", None, b""
            pos = end
            continue
        nxt = data.find(MAGIC, pos)
        while nxt >= 0 and not _begins(data, nxt):  # inside a payload, most likely
            nxt = data.find(MAGIC, nxt + 1)
        # plain records up to the member, unless a record reaches beyond it
        stop = len(data)
        for a, b, fail, head, block in _records(data[pos:], True):
            if nxt >= 0 and fail and pos + b > nxt >= pos + a:
                if pos + a < nxt:
                    yield pos + a, nxt, fail, None, b""
                stop = nxt
                break
            yield pos + a, pos + b, fail, head, block
        pos = stop


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for a, b, fail, head, block in parse(batch.column(1)[i].as_py()):
                    if fail:
                        rows.append((path, a, b - a, "gap", fail, *[None] * 7))
                    else:
                        said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        kind = head.get("warc-type")
                        if kind == "response":
                            digest, size = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
                        else:
                            n = head.get("x-payload-length", "")
                            digest, size = said, int(n) if re.fullmatch("[0-9]+", n) else None
                        rows.append((path, a, b - a, "record", None, kind, _bare(head.get("warc-record-id")), head.get("warc-target-uri"),
                                     _bare(head.get("warc-refers-to")), digest, size, block if payloads else None))
                        held += len(block) if payloads else 0
                    if len(rows) >= 5000 or held > 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return read


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``, with
    the failed check as reason) of all archives in ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,gz,txt}*").load(path)
    return files.select("path", "content").mapInArrow(_reader(payloads), SCHEMA)


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to. A gap in what was
    just written is an error: its page would be missing."""
    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/ledgerloom-warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes=least_bytes)
    common.delete_at_exit(spark, path)
    number = lambda c: F.regexp_extract(c, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")
    gap = F.raise_error(F.format_string("gap in a new archive: %s, %d bytes at %d of %s", "reason", "length", "position", "file")).cast("boolean")
    return read(spark, path, payloads=False).where(F.when(F.col("kind") == "record", True).otherwise(gap)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
