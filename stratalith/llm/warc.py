"""WARC archives as chunked record tables.

Writing. Every page is one record. Its payload is cut on the JVM side into chunks of at most
``CHUNK`` bytes, one row each, before any of it is handed on, so no batch, digest or record
ever holds more than a chunk of a payload. The rows of a record stream through its task in
order with one running SHA-1; a row of the chunk table is (record_id, chunk, total length,
digest so far, bytes), and the digest of the last is the payload's. Longer payloads are
segments (the format's own continuation records). Rows are written as ``.warc`` files by
Spark's text writer, one record a row with a blank line between records, into any folder Spark
can write to. A payload that holds the version line is cut within it, so the line stands
nowhere but at the beginning of records and archives can be split anywhere.

Reading. Files are split at the version line and the splits are parsed where they lie. Payloads of a single segment are digested in place. Segments of longer
ones are dealt by record, ordered by chunk number, and digested as a stream: one running
digest, one chunk in memory, each chunk checked against the digest it carries.

Deduplication. The payloads' digests come from a first pass over the chunks, which keeps
nothing else. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the
largest id is the response and the others are revisits that refer to it. Records are told apart
by id and a hash of the payload.

Null payloads are empty. Rows with a null id are not archived. A repeated id is archived
and reported as often as it stands; copies of the largest id are responses. Extra columns,
whatever they are called, are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage

#: Payload bytes of a segment.
CHUNK = 1 << 14
#: Least payload bytes of a revisit.
LEAST_REVISIT = 1000
#: The end of a record, and the version line that begins one and parts records when archives are split.
_END, _VERSION = b"\r\n\r\n", b"WARC/1.1\r\n"
#: Rows of a chunk table that Python hands back at a time hold about so many bytes.
_OUT_BYTES = 4 << 20
_URN = "urn:page:"

CHUNKS = "record_id string, page_id long, chunk long, total long, digest string, record_type string, refers_to string, url string, body binary"


def cuts(payload: bytes | memoryview, chunk: int = CHUNK) -> list[int]:
    """Bounds of a payload's segments: at most ``chunk`` bytes each, none of which holds the version line."""
    out, n = [0], len(payload)
    while out[-1] < n or len(out) == 1:
        at = out[-1]
        end = min(n, at + chunk)
        found = (bytes(payload[at:end]) + _END).find(_VERSION)  # what follows a segment can complete the line
        out.append(end if found < 0 else at + found + 2)
    return out


def _rows(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """page_id, url, mark (a hash of the payload that tells records of an id apart), total, body."""
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    return rows.select("page_id", "url", F.lower(F.hex(F.xxhash64("body"))).alias("mark"), F.octet_length("body").cast("long").alias("total"), "body")


def split(rows: DataFrame, chunk: int, *columns: str) -> DataFrame:
    """Rows with ``at`` (from 0) and ``body`` cut to chunks, a record's chunks in order in one task; records without bytes have one empty chunk."""
    last = F.greatest(F.ceil(F.col("total") / chunk).cast("int"), F.lit(1)) - 1
    spots = rows.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return spots.select(*columns, "total", "at", F.substring("body", F.col("at") * chunk + 1, F.lit(chunk)).alias("body"))


def digests(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, mark, payload_bytes, payload_digest of every record, by a running digest over its chunks."""

    def f(batches):
        running = None
        for batch in batches:
            found = []
            for page, mark, total, at, body in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if at == 0:
                    running = hashlib.sha1()
                value = body.as_buffer()
                running.update(memoryview(value))
                if (at + 1) * chunk >= total:
                    found.append((page, mark, total, running.hexdigest()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "mark", "payload_bytes", "payload_digest"])

    return split(rows, chunk, "page_id", "mark").mapInArrow(f, "page_id long, mark string, payload_bytes long, payload_digest string")


def dedupe(facts: DataFrame) -> DataFrame:
    """page_id, mark, payload_digest, refers_to of the records that are revisits; only digests and ids are shuffled."""
    groups = facts.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy(F.col("payload_digest").alias("_d")).agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_low"))
    # only payloads that stand under two ids are joined back
    several = groups.where("_low < refers_to").select("_d", "refers_to")
    joined = facts.where(F.col("payload_bytes") >= LEAST_REVISIT).join(several, F.col("payload_digest") == F.col("_d"))
    return joined.where("page_id < refers_to").select("page_id", "mark", "payload_digest", "refers_to").distinct()


def chunk_table(rows: DataFrame, revisits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of CHUNKS for every record; revisits carry no body."""
    again = revisits.select(F.col("page_id").alias("_r"), F.col("mark").alias("_m"), "payload_digest", "refers_to")
    told = rows.join(again, (F.col("page_id") == F.col("_r")) & (F.col("mark") == F.col("_m")), "left")
    told = told.withColumns({"body": F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b"")), "total": F.when(F.col("refers_to").isNull(), F.col("total")).otherwise(0)})
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def f(batches):
        digest, number = None, 0
        for batch in batches:
            held = []
            for page, link, mark, known, to, total, at, value in zip(*(batch.column(i).to_pylist() for i in range(7)), batch.column(7), strict=True):
                if at == 0:
                    digest, number = hashlib.sha1(), 0
                body = memoryview(value.as_buffer())
                bounds = cuts(body, chunk)
                for a, b in zip(bounds, bounds[1:], strict=False):
                    number += 1
                    digest.update(body[a:b])
                    held.append((f"{_URN}{page}:{mark}", page, number, total, digest.hexdigest() if to is None else known, "response" if to is None else "revisit", None if to is None else f"{_URN}{to}:{mark}", link, bytes(body[a:b])))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return split(told, chunk, "page_id", "url", "mark", "payload_digest", "refers_to").mapInArrow(f, CHUNKS)


def _clean(c):
    """A header value: line ends would end the header."""
    return F.replace(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), F.lit("WARC/1.1"), F.lit("WARC/1%2E1"))


def write(chunks: DataFrame, path: str) -> None:
    """Write a chunk table as WARC files: one text row a record, a blank line between records."""
    first, many = F.col("chunk") == 1, F.col("_parts")
    kind = F.when(first, F.col("record_type")).otherwise("continuation")
    lines = [
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.when(first, "").otherwise(F.concat(F.lit(":"), F.col("chunk").cast("string"))), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), F.col("refers_to"), F.lit(">"))),
        F.when(many, F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk").cast("string"))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: <"), F.col("record_id"), F.lit(">"))),
        F.when(many, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"))),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string")),
    ]
    head = F.concat(F.lit(_VERSION.decode()), F.concat_ws("\r\n", *lines), F.lit(_END.decode()))
    # the string type keeps bytes as they are, also where a chunk cuts a character
    row = F.concat(head.cast("binary"), F.col("body")).cast("string")
    with_parts = chunks.withColumn("_parts", (F.col("record_type") == "response") & (F.octet_length("body") < F.col("total")))
    with_parts.select(row.alias("value")).write.option("lineSep", _END.decode()).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments of archives: CHUNKS columns, with the carried digest, parsed split by split."""
    raw = spark.read.option("lineSep", _VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def f(batches):
        for batch in batches:
            held, size = [], 0
            for value in batch.column(0):
                record = memoryview(value.as_buffer())
                if not len(record):  # what stands before a file's first record
                    continue
                probe = 1 << 12
                while (stop := bytes(record[:probe]).find(_END)) < 0:
                    if probe >= len(record):
                        raise ValueError("a record's header does not end")
                    probe *= 2
                fields = dict(line.split(": ", 1) for line in bytes(record[:stop]).decode("utf-8", "replace").split("\r\n"))
                at, length = stop + len(_END), int(fields["Content-Length"])
                if len(record) - at < length or bytes(record[at + length :]) != _END:
                    raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not of the stated length")
                origin = (fields.get("WARC-Segment-Origin-ID") or fields["WARC-Record-ID"])[1:-1]
                to = fields.get("WARC-Refers-To")
                held.append((origin, int(origin.removeprefix(_URN).split(":")[0]), int(fields.get("WARC-Segment-Number", 1)), int(fields.get("WARC-Segment-Total-Length", length)), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], to and to[1:-1], fields.get("WARC-Target-URI"), bytes(record[at : at + length])))
                size += length
                if size >= _OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return raw.mapInArrow(f, CHUNKS)


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string, carried string, copies long"


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its segments, with the digest of the bytes read.

    Records of one segment never move. The segments of others meet by record and stream by
    chunk number; a segment that stands twice belongs to a repeated row with the same payload.
    """
    whole = F.col("total") == F.octet_length("body")
    single = chunks.where(whole | (F.col("record_type") == "revisit")).select(
        "page_id", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest"), "record_type", "refers_to", F.col("digest").alias("carried"), F.lit(1).cast("long").alias("copies")
    )

    def stream(batches):
        now, digest, at, chunk, copies, carried = None, None, 0, 0, 0, None

        def row():
            return pa.RecordBatch.from_pylist([{"page_id": int(now.removeprefix(_URN).split(":")[0]), "payload_bytes": at, "payload_digest": digest.hexdigest(), "record_type": "response", "refers_to": None, "carried": carried, "copies": copies}], _schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page, number = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if page != now:
                    if now is not None:
                        yield row()
                    now, digest, at, chunk, copies = page, hashlib.sha1(), 0, 0, 0
                if number == chunk:  # the same segment of a repeated id
                    copies += chunk == 1
                    continue
                if number != chunk + 1:
                    raise ValueError(f"{page}: segment {chunk + 1} is missing")
                copies += number == 1
                body = batch.column(3)[i].as_buffer()
                digest.update(memoryview(body))
                at, chunk, carried = at + len(body), number, batch.column(2)[i].as_py()
                if digest.hexdigest() != carried:
                    raise ValueError(f"{page}: segment {number} does not have the digest it carries")
        if now is not None:
            yield row()

    parts = chunks.where(~whole & (F.col("record_type") != "revisit")).select("record_id", "chunk", "digest", "body")
    ordered = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk")
    streamed = ordered.mapInArrow(stream, _RECORD)
    copied = streamed.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "carried", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copies"))
    return single.unionByName(copied)


_schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("carried", pa.string()), ("copies", pa.int64())])


def report(found: DataFrame) -> DataFrame:
    """The records of an archive with revisits resolved through the response they refer to."""
    response = found.where("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).dropDuplicates(["_id", "_digest"])
    revisit = found.where("record_type = 'revisit'").withColumn("_to", F.expr(f"cast(split(substring(refers_to, {len(_URN) + 1}), ':')[0] as long)"))
    resolved = revisit.join(response, (F.col("_to") == F.col("_id")) & (F.col("carried") == F.col("_digest")), "left").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("carried").alias("payload_digest"), "record_type", F.col("_to").alias("refers_to"))
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Write pages to archives under ``path`` (the shared folder if none is named) and report what is read back."""
    spark = pages.sparkSession
    path = path or storage.new_path(spark, "warc")
    rows = _rows(pages, key, url, payload)
    revisits = storage.store(dedupe(storage.store(digests(rows, chunk), "digests")), "revisits")
    write(chunk_table(rows, revisits, chunk), path)
    return report(records(read(spark, path)))
