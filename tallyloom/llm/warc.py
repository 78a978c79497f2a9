"""WARC archives as a chunked record table.

A record is rows of (record id, chunk number, bytes): a payload over `chunk_bytes` is cut by built-in functions before any
Python code sees it, each chunk is written as a WARC segment of its own (WARC-Segment-Number, later ones of type
`continuation`), and writer and reader carry SHA-1 from chunk to chunk. So outside the cell of the input table no whole
record is held, and digests of all chunks are compared with the header's when writing and when reading. Archives are
written by Spark's text writer and read by its text reader, with the record boundary as line separator, so that commits,
retries and lost executors are Spark's business and any file system will do. An archive holds one task's share of the
pages; compressed ones are read by one task each, with compression "none" they are split like any text.

Edge cases: a null payload is the empty payload. A null id is written as `null` and comes back as null. Rows with the
same id each get a record and a result row. A segment ends inside any text that would make a record boundary with what
stands before it, headers included, so none stands in a block or at its edges, wherever a payload or a chunk begins. A
null url becomes `urn:pages:ID`. Very long payloads are chunks like others. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import as_text, fresh, small_batches, with_rows

END = "\r\n\r\n"
VERSION = "WARC/1.1"
BOUNDARY = f"{END}{VERSION}\r\n"
#: No block may hold this, with the blank line before it counted.
GUARD = f"{END}{VERSION}".encode()
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column, digits: int = 40) -> Column:
    """Bare base32 of a hex string whose digits are a multiple of five, by built-in functions: 5 hex digits are 20 bits, 4 letters."""
    letters = []
    for at in range(1, digits, 5):
        value = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr(F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_digests(pages: DataFrame, id_col: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """_id, _payload, _url, _bytes, _digest, _type, _target. Of equal payloads the largest id is the response. The
    largest id per digest is pre-aggregated in every task, and a digest with very many rows is split by the skew join."""
    base = pages.select(
        F.col(id_col).cast("long").alias("_id"), as_text(payload).alias("_payload"), (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("_url")
    ).withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_sha1": F.sha1(F.col("_payload").cast("binary"))})
    first = base.filter(F.col("_bytes") >= min_revisit_bytes).groupBy("_sha1", "_bytes").agg(F.max("_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
    many = first.filter("_n > 1").select("_sha1", "_bytes", "_keeper")
    joined = base.join(many, ["_sha1", "_bytes"], "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keeper"))
    return joined.select(
        "_id", "_payload", "_url", "_bytes", base32_of_hex(F.col("_sha1")).alias("_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("_type"), F.when(revisit, F.col("_keeper")).alias("_target"),
    )


def blocks_of(chunk: bytes) -> Iterator[bytes]:
    """The chunk in pieces such that none holds GUARD after the blank line that headers end with; one empty piece of an
    empty chunk."""
    at = 0
    while True:
        found = (END.encode() + chunk[at : at + len(GUARD)]).find(GUARD)  # over the edge
        if found < 0:
            inside = chunk.find(GUARD, at)
            found = inside - at + len(END) if inside >= 0 else -1
        end = len(chunk) if found < 0 else at + found + 2  # after the first letters of the version
        yield chunk[at:end]
        at = end
        if at >= len(chunk):
            return


def chunked(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """records with a row per chunk of the payload, in order: _chunk (from 0), _last, _bytes_of (binary). A revisit has one
    empty chunk."""
    raw = F.col("_payload").cast("binary")
    last = F.when(F.col("_type") == "revisit", 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("_bytes") / chunk_bytes) - 1)).cast("int")
    rows = records.withColumn("_last", last).withColumn("_chunk", F.explode(F.sequence(F.lit(0), "_last")))
    part = F.when(F.col("_type") == "revisit", F.lit(b"")).otherwise(F.substring(raw, F.col("_chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("_id", "_url", "_bytes", "_digest", "_type", "_target", "_chunk", "_last", part.alias("_part"))


def record_rows(date: str):
    """Segments of the chunks of chunked(); the chunks of a record come one after the other."""

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        task = TaskContext.get()
        task_id = task.partitionId() if task else 0
        k = -1
        for row in rows:
            if not row["_chunk"]:
                k, number, sent, running = k + 1, 0, 0, hashlib.sha1()
            key = "null" if row["_id"] is None else row["_id"]
            record = f"<urn:pages:{key}:{task_id}-{k}>"
            uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["_url"]) if row["_url"] else f"urn:pages:{key}"
            revisit = row["_type"] == "revisit"
            running.update(row["_part"])
            pieces = list(blocks_of(row["_part"]))
            for n, piece in enumerate(pieces):
                number += 1
                sent += len(piece)
                last = row["_chunk"] == row["_last"] and n == len(pieces) - 1
                block = (HTTP if number == 1 else b"") + piece
                if last and not revisit and base64.b32encode(running.digest()).decode() != row["_digest"]:
                    raise ValueError(f"the chunks of {record} don't make its payload")
                head = [
                    f"WARC-Type: {row['_type'] if number == 1 else 'continuation'}",
                    f"WARC-Record-ID: {record if number == 1 else f'{record[:-1]}:{number}>'}",
                    f"WARC-Date: {date}",
                    f"WARC-Target-URI: {uri}",
                    f"WARC-Payload-Digest: sha1:{row['_digest']}",
                    f"X-Payload-Length: {row['_bytes']}",
                    "Content-Type: application/http;msgtype=response",
                    f"Content-Length: {len(block)}",
                ]
                if number > 1 or not last:
                    head.append(f"WARC-Segment-Number: {number}")
                if number > 1:
                    head.append(f"WARC-Segment-Origin-ID: {record}")
                    if last:
                        head.append(f"WARC-Segment-Total-Length: {sent + len(HTTP)}")
                if revisit:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:pages:{row['_target']}>"]
                yield ((f"{VERSION}\r\n" + "\r\n".join(head) + END).encode() + block,)

    return make


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = 1 << 20, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes a record a row of pages under path: a response, or a revisit of the response with the same payload."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("value", pa.binary())])
    chunks = chunked(with_digests(pages, id_col, payload, min_revisit_bytes), chunk_bytes)
    # A chunk may end inside a character, so segments are bytes until the writer takes them as they are.
    lines = chunks.mapInArrow(with_rows(record_rows(date), schema), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", END).option("compression", compression).text(path)


SEGMENT = pa.schema([("record", pa.string()), ("segment", pa.int32()), ("type", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("target", pa.string()), ("chunk", pa.binary()), ("done", pa.string())])
SEGMENT_DDL = "record string, segment int, type string, digest string, bytes long, target string, chunk binary, done string"


def parsed(text: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of the records in one piece of an archive; there is one, unless a reader missed a boundary."""
    while text.strip(b"\r\n"):
        text = text.lstrip(b"\r\n")
        text = text[len(VERSION) + 2 :] if text.startswith(VERSION.encode()) else text
        head, found, rest = text.partition(END.encode())
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
        n = int(fields["Content-Length"])
        if not found or len(rest) < n:
            raise ValueError(f"cut record: {head[:200]!r}")
        yield fields, rest[:n]
        text = rest[n:]


def segments(rows: Iterator[dict]) -> Iterator[tuple]:
    for row in rows:
        for f, block in parsed(row["value"]):
            number = int(f.get("WARC-Segment-Number", 1))
            whole = "WARC-Segment-Number" not in f
            body = block.partition(END.encode())[2] if number == 1 else block
            record = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
            done = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None
            yield record, number, f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), f.get("WARC-Refers-To"), None if whole else body, done


def digested(rows: Iterator[dict]) -> Iterator[tuple]:
    """Rows come sorted by record and segment; only one running digest and one chunk are held."""

    def result(first: dict, digest: str, length: int | None) -> tuple:
        revisit = first["type"] == "revisit"
        if not revisit and (digest != first["digest"] or length not in (None, first["bytes"])):
            raise ValueError(f"digest of {first['record']} is {digest}, its header says {first['digest']}")
        ident = lambda urn: None if (k := urn[len("<urn:pages:") :].rstrip(">").split(":")[0]) == "null" else int(k)
        return ident(first["record"]), first["bytes"], first["digest"] if revisit else digest, first["type"], ident(first["target"]) if revisit else None

    first, running, length, expected = None, None, 0, 1
    for row in rows:
        if row["done"] is not None:
            yield result(row, row["done"], None)
            continue
        if row["segment"] == 1:
            if first:
                yield result(first, base64.b32encode(running.digest()).decode(), length)
            first, running, length, expected = row, hashlib.sha1(), 0, 1
        if first is None or row["record"] != first["record"] or row["segment"] != expected:
            raise ValueError(f"segment {row['segment']} of {row['record']} has no predecessor")
        running.update(row["chunk"])
        length, expected = length + len(row["chunk"]), expected + 1
    if first:
        yield result(first, base64.b32encode(running.digest()).decode(), length)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (computed from the bytes read), record_type, refers_to of the records under
    path. Raises ValueError in the task that meets a cut record, a missing segment or a digest unlike its header's."""
    small_batches(spark)
    lines = spark.read.option("lineSep", BOUNDARY).text(path).select(F.col("value").cast("binary"))
    rows = lines.mapInArrow(with_rows(segments, SEGMENT), SEGMENT_DDL)
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return (
        rows.repartition("record")
        .sortWithinPartitions("record", "segment")
        .mapInArrow(with_rows(digested, out), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of pages into the shared folder and returns what reading them back gives."""
    path = fresh(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
k AS (SELECT h, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= 0 GROUP BY h, payload_bytes)
SELECT page_id, d.payload_bytes, {" || ".join(_LETTER.format(at=at, shift=shift) for at in range(1, 40, 5) for shift in (15, 10, 5, 0))} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d JOIN k USING (h, payload_bytes)
"""
