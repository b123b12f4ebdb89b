"""WARC archives written from and read into chunked record tables.

A payload becomes rows of (record, chunk number, bytes) with the running SHA-1 of all bytes up to
the chunk. Every row is written as one WARC record: a ``response`` for the first chunk and
``continuation`` segments for those behind it, so no writer or reader ever joins an oversized
payload. Spark's text source writes and reads the archives, on any file system that Spark reads.

Archives are split at the version line that opens each record. The writer cuts a payload inside
any such line it contains, so no block holds one and the split is safe for every payload.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.config import working_path
from weekloom.llm.common import partitions, stored

VERSION_LINE = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 32 * 1024


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as four numbers of eight digits."""
    digits = F.concat(
        *[F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    )
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunks_of(payload: bytes, chunk_bytes: int):
    """Views of at most ``chunk_bytes``; a version line inside the payload is cut apart."""
    view, at, n = memoryview(payload), 0, len(payload)
    while True:
        end = min(at + chunk_bytes, n)
        found = payload.find(VERSION_LINE, at, end + len(VERSION_LINE) - 1)
        if found >= 0:
            end = min(end, found + 5)
        yield view[at:end]
        at = end
        if at >= n:
            return


def _chunker(chunk_bytes: int, with_data: bool):
    def run(batches):
        for batch in batches:
            keys, payloads = batch.column(0), batch.column(1)
            carried = [c.to_pylist() for c in batch.columns[2:]]
            kinds = [keys.type, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), *[c.type for c in batch.columns[2:]]]
            names = ["record_id", "chunk_no", "end_byte", "last", "digest", "data", *batch.schema.names[2:]]
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                key, payload = keys[i].as_py(), payloads[i].as_py() or b""
                running, end = hashlib.sha1(), 0
                for k, part in enumerate(chunks_of(payload, chunk_bytes)):
                    running.update(part)
                    end += len(part)
                    last = end == len(payload)
                    if with_data or last:
                        digest = base64.b32encode(running.copy().digest()).decode()
                        rows.append((key, k, end, last, digest, bytes(part) if with_data else None, *[c[i] for c in carried]))
                        held += len(part)
                    if held > 8_000_000:  # rows leave in small batches whatever a payload's size
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def chunk_table(records: DataFrame, chunk_bytes: int = SEGMENT_BYTES, with_data: bool = True) -> DataFrame:
    """record_id, chunk_no, end_byte, last, digest (of all bytes up to here), data, and further columns as they are.

    ``records``: record_id, payload (binary, null: empty), further columns. An empty payload is one
    empty chunk. Without data, only the last chunk's row is made: the payload's length and digest.
    """
    kinds = dict(records.dtypes)
    more = [c for c in records.columns if c not in ("record_id", "payload")]
    schema = f"record_id {kinds['record_id']}, chunk_no int, end_byte long, last boolean, digest string, data binary"
    schema += "".join(f", {c} {kinds[c]}" for c in more)
    return records.select("record_id", "payload", *more).mapInArrow(_chunker(chunk_bytes, with_data), schema)


#: Stands for a null id; ids have it percent-encoded.
NO_ID = "~"


def encoded_id(record_id: Column) -> Column:
    """An id of any type as it stands in a record's name: no colon, bracket or blank in it."""
    return F.url_encode(record_id.cast("string"))


def roles(digests: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """record_id, digest, bytes, copies, name and, for revisits, refers_to (the name of their response).

    Of equal payloads of at least ``min_revisit_bytes`` the record with the largest id is the
    response. Only ids and digests move, and copies are counted before they meet. An id on several
    rows is named with the digest; ``copies`` are the rows that share id and digest. A null id has no name.
    """
    many = digests.where("record_id IS NOT NULL").groupBy("record_id").count().where("count > 1")
    many = stored(many.select("record_id", F.lit(True).alias("several")), "repeated_ids")
    several = F.coalesce("several", F.lit(False)).alias("several")
    digests = digests.join(many, "record_id", "left").select("record_id", "digest", "bytes", several)
    holders = digests.groupBy("digest", "bytes").agg(F.max(F.struct("record_id", "several")).alias("holder"))
    joined = digests.join(holders, ["digest", "bytes"])
    revisit = (F.col("bytes") >= min_revisit_bytes) & (F.col("record_id") != F.col("holder.record_id"))

    def name(record_id: str, several: str) -> Column:
        return F.concat(encoded_id(F.col(record_id)), F.when(F.col(several), F.concat(F.lit(":"), "digest")).otherwise(""))

    named = joined.select(
        "record_id", "digest", "bytes", name("record_id", "several").alias("name"),
        F.when(revisit, name("holder.record_id", "holder.several")).alias("refers_to"),
    )
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("copies"))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _uri(value: Column) -> Column:
    """Spaces and controls percent-encoded, so that a header stays one line."""
    out = F.regexp_replace(value, r"[\x00-\x1F\x7F]", "%0A")
    return F.regexp_replace(out, " ", "%20")


def warc_lines(segments: DataFrame, date: str) -> DataFrame:
    """One text value per WARC record; the writer's line end completes it."""
    revisit = F.col("refers_to").isNotNull()
    first = F.col("chunk_no") == 0
    several = ~(first & F.col("last"))
    name = F.concat(F.lit("<urn:record:"), F.col("name"), F.lit(">"))
    own = F.when(first, name).otherwise(F.concat(F.lit("<urn:record:"), F.col("name"), F.lit(":"), F.col("chunk_no") + 1, F.lit(">")))
    kind = F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))
    block = F.col("data")
    head = F.concat(
        F.lit(VERSION_LINE.decode()),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", own),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.when(first, _uri(F.col("url")))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        _field("X-Running-Digest", F.when(several, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Segment-Number", F.when(several, F.col("chunk_no") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, name)),
        _field("WARC-Segment-Total-Length", F.when(several & F.col("last"), F.col("end_byte"))),
        _field("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to"), F.lit(">"))),
        _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _field("X-Payload-Length", F.when(first, F.col("payload_bytes"))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return segments.select(F.concat(head.cast("binary"), block, F.lit(b"\r\n\r")).cast("string").alias("value"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one response or revisit per row as gzipped WARC files below ``path``.

    A text payload is stored as UTF-8, a binary one as it is, null as empty. A row with a null id is
    a response of its own name. Rows that repeat id and payload are all responses, each with a record
    id of its own. Columns other than the three named are not read.
    """
    records = pages.select(
        F.col(id_col).alias("record_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    digests = chunk_table(records.select("record_id", "payload"), segment_bytes, with_data=False)
    digests = stored(digests.select("record_id", "digest", F.col("end_byte").alias("bytes")), "digests")
    said = roles(digests, min_revisit_bytes).select(
        F.col("record_id").alias("_id"), F.col("digest").alias("payload_digest"), F.col("bytes").alias("payload_bytes"), "name", "refers_to", "copies"
    )
    said = stored(said, "roles")

    def meet(some: DataFrame) -> DataFrame:
        same = F.col("record_id").eqNullSafe(F.col("_id")) & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
        return records.join(some, same).drop("_id", "copies")

    # Payloads meet their role on the id, which few rows share: a group of copies stays spread.
    own = meet(said.where("_id IS NULL OR copies = 1"))
    own = own.withColumn("name", F.coalesce("name", F.concat(F.lit(f"{NO_ID}:"), F.uuid())))  # nothing refers to these
    repeated = said.where("_id IS NOT NULL AND copies > 1")
    if not repeated.isEmpty():  # each row has a name of its own, so segments of equal rows stay apart
        k = F.row_number().over(Window.partitionBy("record_id", "payload_digest").orderBy("url"))
        numbered = meet(repeated).withColumn("k", k)
        numbered = numbered.withColumn("name", F.when(F.col("k") > 1, F.concat("name", F.lit(":row"), F.col("k"))).otherwise(F.col("name")))
        own = own.unionByName(numbered.drop("k"))
    own = own.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))  # a revisit's block is empty
    lines = warc_lines(chunk_table(own, segment_bytes), date)
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives: one row per WARC record, headers as a map.

    Fails on a record that is shorter than its Content-Length.
    """
    raw = spark.read.option("lineSep", VERSION_LINE.decode()).text(path).where(F.length("value") > 0)
    at = F.instr("value", "\r\n\r\n")  # headers are ASCII, so this counts bytes
    rows = raw.select(F.col("value").cast("binary").alias("raw"), at.alias("at"))
    rows = rows.select("raw", "at", F.expr(r"str_to_map(cast(substring(raw, 1, at - 1) AS string), '\r\n', ': ')").alias("headers"))
    length = F.col("headers")["Content-Length"].cast("int")
    rows = rows.withColumn("block", F.expr("substring(raw, at + 4, cast(headers['Content-Length'] AS int))"))
    whole = F.when(F.octet_length("block") == length, F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("short WARC record "), F.col("headers")["WARC-Record-ID"])).cast("binary")
    )
    return rows.select("headers", whole.alias("block"))


def _hash_segments(batches):
    """Sorted segments to one row per record; one block is held at a time."""
    record, running, size, expected = None, None, 0, 1
    done: list[tuple] = []

    def close():
        done.append((record, size, base64.b32encode(running.digest()).decode()))

    for batch in batches:
        for i in range(batch.num_rows):
            origin, number = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if origin != record or number == 1 and expected > 1:
                if record is not None:
                    close()
                record, running, size, expected = origin, hashlib.sha1(), 0, 1
            if number != expected:
                raise ValueError(f"segment {expected} of {origin} is missing")
            block = batch.column(2)[i].as_py()
            running.update(block)
            if base64.b32encode(running.copy().digest()).decode() != batch.column(3)[i].as_py():
                raise ValueError(f"segment {number} of {origin} is damaged")
            size += len(block)
            expected += 1
        if done:
            yield _hashed(done)
            done.clear()
    if record is not None:
        close()
        yield _hashed(done)


def _hashed(rows):
    kinds = (("origin", pa.string()), ("n", pa.int64()), ("sha1", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """record_id, payload_bytes, payload_digest, record_type, refers_to, url, intact; one row per record.

    Lengths and digests of responses are those of the bytes read; ``intact`` says whether the headers
    agree. Records of one segment are digested where they are read; only segments of oversized
    payloads are brought together, in order, and hashed one block at a time.
    """
    rows = read_records(spark, path)
    head = F.col("headers")
    number = head["WARC-Segment-Number"].cast("int")

    def ident(name: Column) -> Column:
        found = F.regexp_extract(name, r"^<urn:record:([^:>]*)", 1)
        return F.when(found != NO_ID, F.url_decode(found)).try_cast(id_type)

    def digest(name: Column) -> Column:
        return F.substring(name, 6, 32)

    url = head["WARC-Target-URI"].alias("url")
    single = rows.where(number.isNull()).select(
        ident(head["WARC-Record-ID"]).alias("record_id"),
        F.when(head["WARC-Type"] == "revisit", head["X-Payload-Length"].cast("long"))
        .otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(head["WARC-Type"] == "revisit", digest(head["WARC-Payload-Digest"])).otherwise(base32_sha1(F.col("block"))).alias("payload_digest"),
        head["WARC-Type"].alias("record_type"),
        ident(head["WARC-Refers-To"]).alias("refers_to"),
        url,
        digest(head["WARC-Payload-Digest"]).alias("said"),
    )
    parts = rows.where(number.isNotNull())
    origin = F.coalesce(head["WARC-Segment-Origin-ID"], head["WARC-Record-ID"])
    ordered = (
        parts.select(origin.alias("origin"), number.alias("number"), "block", digest(head["X-Running-Digest"]).alias("running"))
        .repartition(partitions(spark), "origin")
        .sortWithinPartitions("origin", "number")
    )
    hashed = ordered.mapInArrow(_hash_segments, "origin string, n long, sha1 string")
    heads = parts.where(number == 1).select(
        head["WARC-Record-ID"].alias("origin"), url, digest(head["WARC-Payload-Digest"]).alias("said")
    )
    several = hashed.join(heads, "origin").select(
        ident(F.col("origin")).alias("record_id"),
        F.col("n").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast(id_type).alias("refers_to"),
        "url",
        "said",
    )
    both = single.unionByName(several)
    return both.withColumn("intact", F.col("said") == F.col("payload_digest")).drop("said")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = working_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, **options)
    back = read_archives(spark, path, dict(pages.dtypes)[id_col])
    return back.withColumnRenamed("record_id", id_col)
