"""WARC archives in which repeated payloads become revisit records.

Headers (digest, page id, address) are shuffled by payload digest and joined to the first page of
each payload, the original response. What is found for a row comes back to it by its page id and
digest, so payloads are never dealt by their digest. Archives get fresh headers: new record ids,
digests and lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm.common import filesystem, fresh_path, hot_keys, scratch, skew_join, staged

#: Fixed values of the format: the revisit profile and line end.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Rows of marks that may be broadcast; some 30 MB.
FEW = 200_000


def resolve_revisits(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) plus payload_bytes, payload_digest, record_type, refers_to,
    repeated (rows of this id and payload are several), target_url, target_repeated.

    Of the pages with equal payloads of at least ``smallest`` bytes, the one of smallest
    page_id is the response and others revisit it; a row that repeats the page_id as well is
    a response again. A null html is the empty payload; a null page_id never is a target
    while another page has the payload.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", html.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    full = full.withColumn("row", F.xxhash64("page_id", "payload_digest"))
    headers = staged(full.select("page_id", "url", "payload_bytes", "payload_digest", "row"), "warc-headers")
    copies = headers.groupBy("page_id", "payload_digest", "row").agg(F.count("*").alias("n"), F.min("url").alias("url"), F.any_value("payload_bytes").alias("payload_bytes"))
    copies = staged(copies, "warc-copies")
    long = copies.where(F.col("payload_bytes") >= smallest)
    one = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", (F.col("n") > 1).alias("again")))
    first = long.groupBy("payload_digest").agg(one.alias("one"), F.count("*").alias("pages")).where("pages > 1")
    first = staged(first.select("payload_digest", F.col("one.page_id").alias("first_page"), F.col("one.url").alias("target_url"), F.col("one.again").alias("target_repeated")), "warc-first")
    revisits = skew_join(long, first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("first_page").isNotNull())
    marks = revisits.select("row", "page_id", "payload_digest", "first_page", "target_url", "target_repeated", (F.col("n") > 1).alias("repeated"))
    others = copies.where("n > 1").join(revisits.select("row", "page_id", "payload_digest"), ["row", "payload_digest"], "left_anti")
    blank = [F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ("first_page", "target_url", "target_repeated")]
    marks = staged(marks.unionAll(others.select("row", "page_id", "payload_digest", *blank, F.lit(True))), "warc-marks")
    marks = marks.withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    if marks.count() <= FEW:
        out = full.join(F.broadcast(marks.withColumnRenamed("row", "_row")), (F.col("row") == F.col("_row")) & same, "left")
    else:
        out = skew_join(full, marks.select(*marks.columns), "row", "left", hot=hot_keys(headers, "row")).withColumn("first_page", F.when(same, F.col("first_page")))
    again = F.col("first_page").isNotNull()
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("first_page").alias("refers_to"), F.coalesce("repeated", F.lit(False)).alias("repeated"), "target_url", F.coalesce("target_repeated", F.lit(False)).alias("target_repeated"),
    )


def record_id(page_id, digest: str, place: str = "") -> str:
    """An id of the page and its payload; rows that repeat both add their place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}{place}')}>"


def clean(value) -> str:
    """A header value on one line."""
    return " ".join(str(value or "").split())


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str, place: str = "", target_url=None, target_repeated: bool = False) -> bytes:
    """One gzip member with one record. A revisit names its target's record id, but for a target
    that several equal rows hold: address and date tell those."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {clean(target_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if not target_repeated:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2, compresslevel=1, mtime=0)


def records(stream: io.BufferedIOBase):
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != CRLF:
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != CRLF * 2:
            raise ValueError("a record is cut off")
        yield head, block


def parse(head: dict, block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; lengths come from the
    HTTP header, digests of responses are computed anew and must agree."""
    http, _, payload = block.partition(CRLF * 2)
    length = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
        raise ValueError("a block differs from its digest")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    page = head["x-page-id"]
    target = head.get("x-refers-to-page-id")
    return int(page) if page else None, length, digest, kind, int(target) if target else None


def write_archives(pages: DataFrame, out: str, date: str = "2024-01-01T00:00:00Z", smallest: int = 100) -> list[tuple[str, int]]:
    """Writes one archive per task under ``out``; (file, records) for each.

    A task streams its rows. Attempts use names of their own, and only reported names count.
    """

    def write(batches):
        from pyspark import TaskContext

        from loamlog.llm.common import write_atomically

        n, part = 0, TaskContext.get().partitionId()

        def blocks():
            nonlocal n
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, payload, _, digest, kind, target, repeated, target_url, target_repeated = row
                    n += 1
                    yield record(page_id, url, payload, digest, kind, target, date, f"/{part}/{n}" if repeated else "", target_url, target_repeated)

        name = f"{out}/pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        write_atomically(name, blocks())
        yield pa.record_batch([pa.array([name]), pa.array([n])], names=["file", "records"])

    with scratch():
        rows = resolve_revisits(pages, smallest).mapInArrow(write, "file string, records long").collect()
    return sorted((r["file"], r["records"]) for r in rows if r["records"])


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files:
        return spark.createDataFrame([], schema)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = filesystem(name)
                with system.open_input_stream(inner, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
                    held = []
                    for head, block in records(stream):
                        held.append(parse(head, block))
                        if len(held) == 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held = []
                    if held:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives into the shared folder and reads every record back."""
    spark = pages.sparkSession
    files = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(spark, [f for f, _ in files])
