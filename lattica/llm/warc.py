"""WARC archives: a writer with revisit records, and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, checked_broadcast, materialize, new_path, sliced

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
#: What a reader takes for the start of a record once a gzip member is opened.
VERSION = b"WARC/1."
RECORDS = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI (file, s3, gs, hdfs), and the path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as one gzip member; line breaks in header values become spaces."""
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 4, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row under path, a file per task, and returns the files written: path, records, bytes.

    The payload is the text in UTF-8 (null: empty). Of the rows with equal payloads of at least min_bytes bytes, those with the
    largest page_id are response records and the others revisit records that refer to it; rows with shorter payloads are all
    response records. A row without page_id is written with an empty one, and never referred to. A task writes to a name of its
    own attempt and renames the file at its end, so that a repeated task leaves one whole file."""
    where = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    same = materialize(same.where("n > 1").select(F.col("sha").alias("copied"), "first_id"), "copied")
    marked = rows.join(checked_broadcast(same, 250_000), (F.col("sha") == F.col("copied")), "left")
    marked = marked.select("page_id", "url", "html", F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{path}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, at = open_store(draft)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        records = size = 0
        with store.open_output_stream(at) as out:
            for b in sliced(batches, "html"):
                for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                    payload = html.encode()
                    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
                    head += [("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    if refers is not None:
                        head += [("WARC-Refers-To", record_id(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                        payload = b""
                    data = member(head, http + payload, level)
                    out.write(data)
                    records, size = records + 1, size + len(data)
        store.move(at, open_store(name)[1])
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], ["path", "records", "bytes"])

    return materialize(marked.transform(arrow_map, run, "path string, records bigint, bytes bigint"), "archives")


def members(read_at, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each WARC record whose gzip member starts in start:end. read_at(offset, n) gives bytes.

    Until a first member is found, each place with the gzip magic is a candidate and is opened: it counts if it decodes to the
    head of a WARC record and its checksum holds at its end. Members then follow each other; after damage the search goes on."""
    at, held, base = start, b"", start

    def view(offset: int, n: int) -> bytes:
        nonlocal held, base
        if not (base <= offset and offset + n <= base + len(held)):
            held, base = read_at(offset, max(n, READ)), offset
        return held[offset - base : offset - base + n]

    while at < min(end, size):
        data = view(at, min(READ, size - at))
        hit = data.find(MAGIC)
        if hit < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        unpack, parts, here, sound = zlib.decompressobj(31), [], at, True
        try:
            while not unpack.eof and here < size:
                chunk = view(here, min(1 << 16, size - here))
                here += len(chunk)
                parts.append(unpack.decompress(chunk))
                if parts and len(parts[0]) >= len(VERSION) and not parts[0].startswith(VERSION):
                    sound = False
                    break
        except zlib.error:
            sound = False
        content = b"".join(parts) if sound and unpack.eof else b""
        if content.startswith(VERSION):
            yield at, content
            at = here - len(unpack.unused_data)
        else:
            at += 1


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers.get("content-length", 0))]


def read_warc(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of all .warc.gz files under path, one row each; a file is read by several tasks, each of which owns the
    records that start in its range of split_bytes. payload is the body of an http response, or the block of other records.
    An empty folder gives an empty result."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    tasks = max(1, min(10_000, ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                store, at = open_store(name)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for offset, content in members(lambda o, n: f.read_at(n, o), size, start, start + split_bytes):
                        h, block = parse(content)
                        payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                        rows.append((name, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(h["warc-payload-length"]) if h.get("warc-payload-length", "").isdigit() else len(payload), payload))
                        held += len(payload)
                        if held > READ * 4:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return ranges.repartition(tasks, "path", "start").transform(arrow_map, run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to per row.
    The digest of a response is computed again from the payload that was read; a revisit's is the one in its header."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    read = read_warc(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("payload").to_pylist()
            kinds = b.column("record_type").to_pylist()
            said = b.column("payload_digest").to_pylist()
            digests = [digest(p) if k == "response" else (s or "").removeprefix("sha1:") for p, k, s in zip(own, kinds, said)]
            sizes = [len(p) if k == "response" else n for p, k, n in zip(own, kinds, b.column("payload_length").to_pylist())]
            ids = [[int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None for x in b.column(c).to_pylist()] for c in ("record_id", "refers_to")]
            yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(ids[1], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read.transform(arrow_map, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
