"""WARC archives: written by Spark's writer, read back, and assembled.

Each capture is written as three records: the request, the response (or a
revisit of an equal payload) and a metadata record. Request and metadata name
the response in WARC-Concurrent-To. Reading parses records by their
Content-Length, so payloads may hold anything, the record marks included.
``assemble`` groups the three kinds through those identifiers into one nested
row per capture.

Archives are written through Spark's own file commit, on whatever store the
folder is on. Files are kept small by bounding the records of one file;
records with large payloads go to files of their own kind with fewer records.

Defined results: null html is an empty payload; a null url is written without
a target; equal payloads of at least ``min_revisit_bytes`` have one response,
the one with the largest id (null ids are never the largest; if several rows
share that id they are all responses); repeated rows are captures of their
own; an empty table gives an archive without records; other columns are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.operators.broadcast import bounded_broadcast
from lexiforge.session import ensure_checkpoint_dir, materialize

DATE = "2024-01-01T00:00:00Z"
RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, "
          "target_uri string, payload_digest string, payload_bytes long, fields map<string,string>, "
          "payload binary")


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"))]
    for name, value in headers:
        parts.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit("")))
    parts.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                          F.lit("\r\n\r\n"), block))
    return F.concat(*parts)


def mark_revisits(pages: DataFrame, key: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """Add _digest, _bytes, _first (the key of the response with the same payload, null
    where the row is itself a response), _refers (the end of that response's record
    ids) and _uid (the end of the row's own)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    d = pages.withColumn("_digest", F.sha1(body)).withColumn("_bytes", F.octet_length(body).cast("long"))
    # Largest id per digest: a partial aggregate; only digests that repeat are joined back.
    largest = (d.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest", key).agg(F.count("*").alias("_n"))
               .groupBy("_digest").agg(F.max(key).alias("_max"), F.max_by("_n", key).alias("_copies"), F.sum("_n").alias("_n"))
               .where("_n > 1").select(F.col("_digest").alias("_d"), "_max", "_copies", F.expr("uuid()").alias("_refers")))
    # Few payloads repeat as a rule: the table goes to all tasks if a count shows
    # that it is small, else both sides are shuffled.
    written = materialize(largest, "warc-repeats")
    largest, _ = bounded_broadcast(written, 500_000)
    d = d.join(largest, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") >= min_revisit_bytes), "left").withColumn(
        "_holds", F.col("_max").isNotNull() & F.col(key).eqNullSafe(F.col("_max")))
    # the response that others refer to has the id fixed above; all other ids are drawn
    drawn = F.expr("uuid()")
    if written.where("_copies > 1").isEmpty():
        d = d.withColumn("_uid", F.when(F.col("_holds"), F.col("_refers")).otherwise(drawn))
    else:      # of rows that repeat under one key, one is referred to
        many = F.col("_holds") & (F.col("_copies") > 1)
        nth = F.row_number().over(Window.partitionBy("_digest").orderBy("_digest"))
        copies = d.where(many).withColumn("_uid", F.when(nth == 1, F.col("_refers")).otherwise(drawn))
        d = d.where(~many).withColumn("_uid", F.when(F.col("_holds"), F.col("_refers")).otherwise(drawn)).unionByName(copies)
    return (d.withColumn("_first", F.when(F.col("_max").isNotNull() & ~F.col("_holds"), F.col("_max")))
            .drop("_d", "_max", "_copies", "_holds"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url",
               payload: str = "html", min_revisit_bytes: int = 1000,
               large_bytes: int = 1 << 16, records_per_file: int = 1500) -> None:
    """Write three records per row below ``path``. A file holds payloads of at most
    ``large_bytes * records_per_file / 3`` bytes (32 MB), or of ten larger payloads."""
    d = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u"),
                     F.col(f"`{payload}`").alias("p"))
    d = mark_revisits(d, "k", "p", min_revisit_bytes)
    name = F.coalesce(F.col("k").cast("string"), F.lit("null"))
    def rid(kind: str) -> Column:
        return F.concat(F.lit(f"<urn:capture:{kind}:"), name, F.lit(":"), F.col("_uid"), F.lit(">"))
    main = rid("main")
    revisit = F.col("_first").isNotNull()
    uri = F.regexp_replace(F.col("u"), r"[\r\n]+", "")
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]
    request = _record("request", [
        ("WARC-Record-ID", rid("request")), ("WARC-Concurrent-To", main), *common,
        ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "),
                 F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")))
    response = _record(F.when(revisit, "revisit").otherwise("response"), [
        ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:capture:main:"), F.col("_first").cast("string"), F.lit(":"),
                                                     F.col("_refers"), F.lit(">")))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("p"), F.lit("")))))
    metadata = _record("metadata", [
        ("WARC-Record-ID", rid("metadata")), ("WARC-Concurrent-To", main), *common,
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("key: "), name, F.lit("\r\npayloadLength: "), F.col("_bytes").cast("string"), F.lit("\r\n")))
    rows = d.select("_bytes", F.explode(F.array(request, response, metadata)).alias("value"))
    large = F.col("_bytes") > large_bytes
    for part, cond, per_file in (("small", ~large, records_per_file),
                                 ("large", large, max(3, records_per_file // 50))):
        (rows.where(cond).select("value").write.mode("overwrite").option("lineSep", "\r\n\r\n")
         .option("maxRecordsPerFile", per_file).text(f"{path}/{part}"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record of an uncompressed or gzipped archive."""
    if data[:2] == b"\x1f\x8b":
        import gzip
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode("utf-8").strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, view[start:stop]
        at = stop


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below ``path``. The payload digest is
    computed from the payload where the record has one, else taken from its header."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(path).select("content"))
    names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for h, block in parse_records(batch.column(0)[i].as_py()):
                    kind, fields, body = h.get("warc-type"), None, None
                    digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    if kind == "metadata":
                        pairs = (x.partition(":") for x in bytes(block).decode("utf-8").split("\r\n") if x)
                        fields = [(a.strip(), b.strip()) for a, _, b in pairs]
                    elif kind == "response":
                        raw = bytes(block)
                        body = raw[raw.find(b"\r\n\r\n") + 4:]
                        digest = hashlib.sha1(body).hexdigest()
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"),
                                 h.get("warc-refers-to"), h.get("warc-target-uri"), digest,
                                 None if body is None else len(body), fields,
                                 body if with_payload else None))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, record_type, main, request, metadata)."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    def part(name: str, *kinds: str) -> Column:
        return F.first(F.when(F.col("record_type").isin(*kinds), whole), ignorenulls=True).alias(name)
    own = F.col("record_type").isin("response", "revisit")
    return (records.groupBy(F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"))
            .agg(part("main", "response", "revisit"), part("request", "request"), part("metadata", "metadata"))
            .where("main IS NOT NULL")
            .select("capture_id", F.col("main.record_type").alias("record_type"), "main", "request", "metadata"))


def new_archive_path(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def captures(pages: DataFrame, path: str | None = None, with_payload: bool = False, **options) -> DataFrame:
    """Write the archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or new_archive_path(spark)
    write_warc(pages, path, **options)
    return assemble(read_warc(spark, path, with_payload))
