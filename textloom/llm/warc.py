"""WARC: a chunked record table, written to archives and read back.

``chunk_records`` turns records into rows (record, chunk number): a payload of any size becomes
chunks of at most ``chunk_bytes``, each carrying the SHA-1 of the payload up to and including it, so
no later step holds more than a chunk. ``write_archives`` writes the chunk rows as WARC/1.1 through
Spark's own text writer (any file system, task-commit protocol): one record per chunk, a
``response`` first and ``continuation`` segments after it; a chunk's block ends with the CR LF CR LF
that the writer puts between rows. ``read_archives`` inflates archives as a stream through Spark's text
reader, cut where the writer's line ends are, keeps one segment at a time, carries the digest of a record
from segment to segment and tests it against the headers. An archive that is cut off or damaged raises an error.

Defined cases: a null payload is empty. Of records with equal payloads of at least ``least`` bytes the
one with the largest id is the response and the others are revisits without a payload; rows that
repeat that id are all responses. A null id is kept as null and is response only if all ids of its
group are null. CR, LF and other control characters in an address are written as %XX. Ids are
integers. Columns other than id, address and payload are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

CHUNK_BYTES = 256 << 10
GAP = b"\r\n\r\n"
_RECORD = "rec_id long, url string, payload_bytes long, digest string, refers_to long, revisit boolean"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = 0) -> DataFrame:
    """(rec_id, url, payload, refers_to, revisit): which records repeat the payload of another.

    Only digests are aggregated (map-side combined). The join back is on the digest, both sides
    plainly shuffled, so the adaptive planner splits the partition of a payload that many rows share.
    """
    rows = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    shared = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max("rec_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "best")
    revisit = F.col("best").isNotNull() & ~F.col("rec_id").eqNullSafe(F.col("best"))
    joined = rows.join(shared, "sha", "left").withColumn("revisit", revisit)
    return joined.select("rec_id", "url", F.when(~F.col("revisit"), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.length("payload").cast("long").alias("payload_bytes"), "sha", F.when(F.col("revisit"), F.col("best")).alias("refers_to"), "revisit")


def chunk_records(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per (record, chunk): ``chunk_no`` from 0, ``last``, ``data``, and ``running``, the
    SHA-1 (base32) of the payload up to the end of this chunk. An empty payload is one empty chunk.
    """
    names = ["rec_id", "url", "payload_bytes", "digest", "refers_to", "revisit", "chunk_no", "last", "running", "data"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        for b in batches:
            heads = b.drop_columns(["payload"]).to_pylist()
            rows, held = [], 0
            for head, cell in zip(heads, b.column("payload"), strict=True):
                view = memoryview(cell.as_buffer())
                sha = hashlib.sha1()
                whole = b32(bytes(head["sha"]))
                for at in range(0, max(1, len(view)), chunk_bytes):
                    part = view[at : at + chunk_bytes]
                    sha.update(part)
                    last = at + chunk_bytes >= len(view)
                    running = b32(sha.digest())
                    rows.append((head["rec_id"], head["url"], head["payload_bytes"], whole, head["refers_to"], head["revisit"], at // chunk_bytes, last, running, bytes(part)))
                    held += len(part)
                    if held >= 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    schema = f"{_RECORD}, chunk_no long, last boolean, running string, data binary"
    return records.select("rec_id", "url", "payload", "payload_bytes", "sha", "refers_to", "revisit").mapInArrow(run, schema)


def _header(kind: str, date: str):
    """The header of a chunk's record, and the first line of its block, as a string column."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda cond, col: F.when(cond, col).otherwise(F.lit(""))
    ident = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    segment = F.col("chunk_no").cast("string")
    part = F.col("chunk_no") > 0
    http = F.when(~part & ~F.col("revisit"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))).otherwise(F.lit(""))
    length = (F.length(http) + F.length("data")).cast("string")
    url = F.concat_ws("", F.transform(F.split(F.coalesce("url", F.lit("")), ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), url).otherwise(F.coalesce("url", F.lit("")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(part, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(part, F.concat(F.lit("<urn:row:"), F.coalesce(F.col("rec_id").cast("string"), F.lit("null")), F.lit(":"), segment, F.lit(">"))).otherwise(ident("rec_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Running-Digest", F.concat(F.lit("sha1:"), F.col("running"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        some(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", ident("refers_to")))),
        some(part | ~F.col("last"), line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))),
        some(part, line("WARC-Segment-Origin-ID", ident("rec_id"))),
        some(part & F.col("last"), line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length),
        F.lit("\r\n"),
        http,
    )


def write_archives(chunks: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write chunk rows, in their order, as gzip-compressed WARC files below ``path``."""
    block = F.concat(_header("chunk", date).cast("binary"), F.col("data")).cast("string")
    chunks.select(block.alias("value")).write.option("lineSep", GAP.decode()).option("compression", "gzip").text(path)


def segments(parts):
    """(headers, block) of each record of one archive; ``parts`` are what lies between its gaps, in order."""
    parts, have = iter(parts), bytearray()

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            have.extend(part + GAP)
        return part is not None

    # the last part may stand for a line end without a gap, which leaves one gap too many
    while have not in (b"", GAP) or more():
        at = have.index(GAP)
        head = bytes(have[:at])
        fields = dict(line.partition(": ")[::2] for line in head.decode(errors="replace").split("\r\n"))
        if not head.startswith(b"WARC/") or not fields.get("Content-Length", "").isdigit():
            raise ValueError("no WARC record where one should start")
        del have[: at + len(GAP)]
        size = int(fields["Content-Length"])
        while len(have) < size + len(GAP):
            if not more():
                raise ValueError("WARC file cut off")
        if have[size : size + len(GAP)] != GAP:
            raise ValueError("WARC record not closed")
        block = bytes(have[:size])
        del have[: size + len(GAP)]
        yield fields, block


def _row_id(urn: str) -> int | None:
    text = urn[len("<urn:row:") : -1]
    return None if text == "null" else int(text)


def records_of(parts):
    """(rec_id, payload_bytes, digest, record_type, refers_to, segments) of each record of one archive.

    The digest is recomputed from the payload read, segment by segment, and must equal the header's;
    a revisit has the digest its header gives.
    """
    sha = row = None
    for fields, block in segments(parts):
        kind = fields["WARC-Type"]
        if kind == "continuation":
            if row is None or _row_id(fields["WARC-Segment-Origin-ID"]) != row[0]:
                raise ValueError("WARC continuation without its first segment")
            sha.update(block)
            row[5] += 1
            read = row[6] = row[6] + len(block)
            done = "WARC-Segment-Total-Length" in fields
        else:
            if row is not None:
                raise ValueError("WARC record without its last segment")
            sha = hashlib.sha1()
            row = [_row_id(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, None, 1, 0]
            if kind == "revisit":
                row[4] = _row_id(fields["WARC-Refers-To"])
            else:
                payload = block[block.index(GAP) + len(GAP) :]
                sha.update(payload)
                row[6] = len(payload)
            read, done = row[6], "WARC-Segment-Number" not in fields
        if kind != "revisit" and b32(sha.digest()) != fields["X-Running-Digest"].removeprefix("sha1:"):
            raise ValueError("WARC running digest differs")
        if done:
            if kind != "revisit" and (b32(sha.digest()) != row[2] or read != row[1]):
                raise ValueError("WARC payload digest differs")
            yield tuple(row[:6])
            row = None
    if row is not None:
        raise ValueError("WARC record without its last segment")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    Spark's text source inflates each archive as a stream and cuts it at the gaps; a gzip file is never split, so its
    parts come to one task in their order. No part is longer than a chunk, and a part goes once its record is read.
    """
    names = ["rec_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        parts = ((file, v.as_py()) for b in batches for file, v in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        records = chain.from_iterable(records_of(part for _, part in own) for _, own in groupby(parts, itemgetter(0)))
        while rows := list(islice(records, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.option("lineSep", GAP.decode()).option("pathGlobFilter", "part-*").text(path)
    parts = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("part"))
    return parts.mapInArrow(run, "rec_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments long")


def roundtrip(df: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    path = shared_dir(df.sparkSession, "warc")
    write_archives(chunk_records(mark_revisits(df, id_col, payload_col, url_col, least), chunk_bytes), path)
    return read_archives(df.sparkSession, path).withColumnRenamed("rec_id", id_col)


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to, 1::BIGINT AS segments
FROM p
"""
