"""WARC archives of pages: written with Spark's text sink, read by verified record chains.

A record says where the next one begins. Readers find every place that looks
like the start of a record, whatever lies there, and note its successor. From
the start of each file, pointer jumping doubles the number of records known to
be reachable with every round; whatever merely looks like a record inside a
payload is not on the chain and is never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import stage

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Headers read beyond the end of a block at a time.
MARGIN = 1 << 16

CANDIDATES = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("successor", T.LongType())])
RECORDS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
])


# --- writing ------------------------------------------------------------------

def with_roles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to.

    Null html is empty. Of rows with equal payloads of at least ``least_bytes``
    those with the largest page_id are responses, the others revisit it. A row
    without a page_id revisits if another row with its payload has one.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    # Pre-aggregated, and only payloads that occur twice: broadcast where the written table is small, else a join that splits hot payloads.
    holders = base.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    holders = stage(holders.where("n > 1 and holder is not null").drop("n"), "holders")
    revisits = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return base.join(holders, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("holder")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, path: str) -> None:
    """One record per page, in as many files as tasks; Spark commits only what finished tasks wrote."""
    rows = with_roles(pages)
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), F.translate(value.cast("string"), "\r\n", ""), F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    record = F.concat(
        F.lit("WARC/1.0\r\n"), head("WARC-Type", F.col("record_type")), head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        head("WARC-Target-URI", F.col("url")), head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        head("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        head("X-Page-ID", F.col("page_id")), head("X-Refers-To-Page", F.col("refers_to")), head("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), head("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


# --- reading ------------------------------------------------------------------

def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return where.open_input_file(inner)


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and their length in bytes of a record that begins ``data``; None if they don't end there or lack a valid length."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not MAGIC.match(data):
        return None
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return (headers, end + 4) if headers.get("content-length", "").isdigit() else None


def _head_at(file, data: bytes, start: int, at: int) -> tuple[dict[str, str], int] | None:
    """The head at ``at``, of which ``data`` (read from ``start``) may hold only a part."""
    own, more = data[at - start:at - start + MARGIN], MARGIN
    while b"\r\n\r\n" not in own:
        before = len(own)
        own = file.read_at(before + more, at)
        if len(own) <= before:
            return None
        more *= 2
        if more > 1 << 24:  # no head is as long as this; a chain that needed it breaks and is reported
            return None
    return parse_head(own)


def candidates(spark: SparkSession, path: str, block_bytes: int) -> DataFrame:
    """(path, length, offset, successor) of whatever looks like a record, found block by block."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    blocks = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))))
    blocks = blocks.repartition(spark.sparkContext.defaultParallelism, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, length, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _open(path) as file:
                    data = file.read_at(block_bytes + 16, start)
                    for found in MAGIC.finditer(data):
                        at = start + found.start()
                        head = _head_at(file, data, start, at) if at < start + block_bytes else None
                        if head:
                            successor = at + head[1] + int(head[0]["content-length"]) + len(END)
                            if successor <= length:
                                out.append((path, length, at, successor))
            yield pa.RecordBatch.from_pylist([dict(zip(CANDIDATES.names, r)) for r in out], schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("successor", pa.int64())]))

    return blocks.mapInArrow(run, CANDIDATES)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file.

    Round k knows the records reached in fewer than 2**k steps and where 2**k
    steps lead from anywhere, so a file of n candidates takes about log2(n)
    rounds. Each round ends in a table of the shared folder.
    """
    found = stage(found, "candidates")
    now = found.select("path", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("reached"))
    known = -1
    while True:
        count = now.agg(F.count_if("reached")).first()[0]
        if count == known:
            break
        known = count
        on = now.select("path", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        marks = now.where("reached").select("path", F.col("jump").alias("offset"), F.lit(True).alias("marked")).distinct()
        now = now.join(on, ["path", "jump"], "left").join(marks, ["path", "offset"], "left")
        now = stage(now.select("path", "offset", F.coalesce("further", "jump").alias("jump"), (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")), "jumps")
    return found.join(now.where("reached").select("path", "offset"), ["path", "offset"], "left_semi")


def read_records(spark: SparkSession, path: str, block_bytes: int = 8 << 20) -> DataFrame:
    """path, offset, headers (lower-case names) and payload of every record under ``path``.

    The payload of an HTTP block is what follows its headers, else the whole
    block. A file whose chain doesn't end at its last byte is damaged: an error,
    never a silent loss. An empty folder gives no rows.
    """
    chain = stage(reachable(candidates(spark, path, block_bytes)), "chain")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ends = files.join(chain.groupBy("path").agg(F.max("successor").alias("end")), "path", "left").where("end is null or end != length")
    broken = ends.select("path").limit(3).collect()
    if broken:
        raise ValueError(f"the record chain breaks off in {', '.join(r.path for r in broken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            out = {"path": [], "offset": [], "headers": [], "payload": []}
            for path, offset, successor in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    opened, file = path, _open(path)
                data = file.read_at(successor - offset, offset)
                headers, begin = parse_head(data)
                block = data[begin:begin + int(headers["content-length"])]
                if headers.get("content-type", "").startswith("application/http"):
                    block = block[block.find(b"\r\n\r\n") + 4:]
                for k, v in (("path", path), ("offset", offset), ("headers", list(headers.items())), ("payload", block)):
                    out[k].append(v)
                if len(out["path"]) >= 500:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out = {k: [] for k in out}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
    near = chain.select("path", "offset", "successor").repartitionByRange(spark.sparkContext.defaultParallelism, "path", "offset").sortWithinPartitions("path", "offset")
    return near.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, path: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Write ``pages`` to ``path``, read them back, and tell what each record holds.

    payload_bytes and payload_digest of a response are taken from the bytes
    read back; ``intact`` says whether they agree with its headers.
    """
    write_archive(pages, path)
    records = read_records(pages.sparkSession, path, block_bytes)
    header = lambda name: F.element_at("headers", F.lit(name))
    response = header("warc-type") == "response"
    told = F.regexp_replace(header("warc-payload-digest"), "^sha1:", "")
    read = records.select(
        header("x-page-id").cast("long").alias("page_id"), header("warc-target-uri").alias("url"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(header("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(told).alias("payload_digest"),
        header("warc-type").alias("record_type"), header("x-refers-to-page").cast("long").alias("refers_to"), told.alias("told"),
    )
    return read.withColumn("intact", F.col("payload_digest") == F.col("told")).drop("told")
