"""WARC archives compressed with a Zstandard dictionary of their own.

An archive begins with a skippable frame holding a dictionary built from records of that archive;
each record after it is a frame by itself, so a reader may start at any record. Equal payloads are
stored once: later ones become revisit records that name the stored one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, read, small

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are always stored.
LEAST_SHARED_BYTES = 100
#: An archive is closed once its records, uncompressed, reach this size.
ARCHIVE_BYTES = 32 << 20
#: Bounds of the dictionary and of the archive's records it is built from.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
#: Bytes of archives that a task reads.
READ_BYTES = 256 << 20

_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)
_RECORDS_DDL = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"


def _urn(id_: str) -> str:
    return "<urn:page:" + "".join(c if c.isalnum() or c in "-_." else "".join(f"%{b:02X}" for b in c.encode()) for c in id_) + ">"


def _from_urn(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def record(id_: str | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the payload's length, and no payload.

    A page without id gets a record id of its own, which names no page.
    """
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    head.append(f"WARC-Record-ID: {_urn(id_) if id_ is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(" " if ord(c) < 32 else c for c in url).strip())
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of ``_RECORDS`` from one record's bytes.

    Length and digest of a stored payload are those of the payload as read; if the headers say
    otherwise the archive is damaged. A revisit has but its headers.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        told, (length, digest) = (length, digest), (len(payload), hashlib.sha256(payload).hexdigest())
        if told != (length, digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} has {length} bytes and digest {digest}, not {told[0]} and {told[1]}")
    return (
        _from_urn(fields["WARC-Record-ID"]),
        kind,
        length,
        digest,
        _from_urn(fields.get("WARC-Refers-To")),
        fields.get("WARC-Target-URI"),
        payload if kind == "response" else None,
    )


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """From records spread evenly over the archive, ``SAMPLE_BYTES`` at most."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples, size = [], 0
    for r in records[::step]:
        part = r[: 64 << 10]  # the head of a long record is as telling as the whole
        if size + len(part) > SAMPLE_BYTES:
            break
        samples.append(part)
        size += len(part)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:  # too few records to train on: their bytes serve as they are
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    for r in records:
        yield compressor.compress(r)


def unarchive(stream) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    raw = stream.read(size)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = stream.read(1 << 20)
    while rest:
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        rest = rest or stream.read(1 << 20)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI as Spark understands it: without a scheme it is in the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    return pa.fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives when run; the result's rows name them: archive, records, bytes.

    Only archives named in the result count. A task that is run again writes under another name.

    Defined results: a null html is an empty payload; a null url gives a record without target; a
    null id gives a record that names no page and is never referred to; rows that repeat the smallest id of a
    payload are all stored; an empty table gives no archive; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc_keepers")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    long = F.col("n_bytes") >= LEAST_SHARED_BYTES
    shared = rows.filter(long).groupBy("digest").agg(F.min("id").alias("keeper"), F.count("*").alias("k"))
    shared = scratch.table(shared.filter("k > 1").select("digest", "keeper"), "keepers")
    # Short payloads, the empty one above all, have no keeper and don't meet in the join.
    short = rows.filter(~long).withColumn("keeper", F.lit(None).cast(pages.schema[id_col].dataType))
    rows = rows.filter(long).join(small(shared, "digest"), "digest", "left").select(short.columns).unionByName(short)
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("id")), F.col("keeper")).cast("string")
    rows = rows.select(F.col("id").cast("string"), "url", "payload", "n_bytes", "digest", refers.alias("refers_to"))
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    folder = qualified(pages.sparkSession, folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        task, made = TaskContext.get(), 0

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            size = 0
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                for piece in archive(records):
                    out.write(piece)
                    size += len(piece)
            return next(batches(_MANIFEST, [(f"{folder}/{name}", len(records), size)]))

        held: list[bytes] = []
        size = 0
        for batch in it:
            for id_, url, payload, n, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(id_, url, payload or b"", n, digest, refers_to, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(held)
                    held, size, made = [], 0, made + 1
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that ``manifest`` (a stored table, as ``write_archives`` gives it) names.

    A task reads about ``READ_BYTES`` of archives, less where the cluster has idle cores.

    Defined results: an empty manifest gives no records; an archive that is damaged, or doesn't begin with
    its dictionary, is an error; an archive that is named twice is read twice; other columns are not read.
    """
    total = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(total.n, max(2 * cores, -(-total.bytes // READ_BYTES))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for path in batch.column(0).to_pylist():
                    fs, inner = _filesystem(path)
                    with fs.open_input_stream(inner, compression=None) as stream:
                        for data in unarchive(stream):
                            got = parse(data)
                            yield got if with_payload else (*got[:-1], None)

        yield from batches(_RECORDS, rows())

    return manifest.select("archive").repartition(n).mapInArrow(run, _RECORDS_DDL)


def unfounded(records: DataFrame) -> DataFrame:
    """refers_to, payload_bytes, payload_digest, n: what revisits claim that no response bears out.

    A revisit has no payload of its own: its length and digest have to be those of the response that it names.
    Revisits that claim the same are one row before they meet the responses, however many they are.
    """
    claims = records.filter("record_type = 'revisit'").groupBy("refers_to", "payload_bytes", "payload_digest").agg(F.count("*").alias("n"))
    stored = records.filter("record_type = 'response' and record_id is not null").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    return claims.join(stored, ["refers_to", "payload_bytes", "payload_digest"], "left_anti")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scratch = read(spark, sf_dir, "pages"), Scratch(spark, "warc")
    manifest = scratch.table(write_archives(pages, scratch.path("archives")), "manifest")
    id_type = pages.schema["page_id"].dataType
    records = scratch.table(read_archives(manifest, with_payload=False).drop("payload"), "records")
    if (wrong := unfounded(records).first()) is not None:
        raise ValueError(f"revisits of {wrong.refers_to} claim a payload that it has not")
    return records.select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT digest, min(page_id) AS keeper FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""
