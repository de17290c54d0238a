"""WARC archives: whole-file gzip streams, a normaliser to one member a record, and a sidecar index."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import arrow_schema, pick, shared_path, stored

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Groups of equal payloads up to which they are broadcast (about 100 bytes each).
FEW = 100_000
#: Largest payload of each class of pages, and records of an archive of that class: 64 MiB of payloads, or one larger record.
CLASSES = ((1 << 16, 1024), (1 << 20, 64), (1 << 23, 8), (1 << 40, 1))
#: What stands between the records of an archive.
BETWEEN = "\r\n\r\n"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, refers_to`` of each row.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest
    key is the response and the others refer to it; repeated rows of that smallest key
    are responses too. Null payloads are empty. Groups are counted without their
    payloads; a group that holds much of the table is one key of a join that Spark
    splits.
    """
    rows = pick(pages, page_id=key, payload=payload, **({"url": url} if url else {}))
    if not url:
        rows = rows.withColumn("url", F.lit(None).cast("string"))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("payload", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", F.col("payload").cast("string").alias("payload"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    same = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    same = stored(same.where("first < last").select(F.col("digest").alias("group"), "first"), "revisits")
    # Few groups are sent to every executor and payloads stay where they are; many are joined by digest.
    few = same.count() <= FEW
    joined = rows.join(F.broadcast(same) if few else same, rows["digest"] == same["group"], "left")
    refers = F.when((F.col("payload_bytes") >= least) & (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", refers.alias("refers_to"))


def records(rows: DataFrame) -> DataFrame:
    """The text of one WARC record a row: a response with its payload, or a revisit without it. Null ids are written as an empty field."""
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def largest_payload(pages: DataFrame, payload: str = "html") -> int:
    return pick(pages, payload=payload).agg(F.max(F.octet_length("payload"))).first()[0] or 0


def write_archives(rows: DataFrame, path: str, largest: int) -> None:
    """One gzip stream a file, by Spark's own writer, of at most 64 MiB of payloads or one larger one.

    Pages go to archives of their size class, so the number of records bounds the bytes;
    there is one pass for each class up to that of the ``largest`` payload.
    """
    least = -1
    for most, records_ in CLASSES:
        part = rows.where(F.col("payload_bytes").between(least + 1, most))
        records(part).write.mode("append").option("maxRecordsPerFile", records_).option("lineSep", BETWEEN).option("compression", "gzip").text(path)
        least = most
        if largest <= most:
            break


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record, in one pass over a stream's pieces; at most one record and piece are held."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(stream, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if held.strip():
                raise ValueError(f"{len(held)} bytes after the last record")
            return
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(head["content-length"])
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError("the last record is cut short")
        yield head, bytes(held[at + 4 : end])
        del held[: end + 4]


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The stream of a gzip file, member after member, in pieces."""
    at, size = 0, len(content)
    while at < size:
        unzip = zlib.decompressobj(31)
        while not unzip.eof and at < size:
            piece = unzip.decompress(content[at : at + step])
            at += step
            if piece:
                yield piece
        if not unzip.eof:
            raise ValueError("the gzip stream is cut short")
        at = min(at, size) - len(unzip.unused_data)
        while at < size and content[at] == 0:
            at += 1


#: Fixed part of a member's gzip header with an extra field, and of the subfield "sl" of two 32-bit numbers.
HEAD, SKIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff", b"\x0c\x00sl\x08\x00"
HEAD_SIZE = len(HEAD) + len(SKIP) + 8


def member(record: bytes) -> bytes:
    """A gzip member whose header's ``sl`` field tells the member's size and the record's, so that readers can skip it; zero for sizes over 32 bits."""
    body = zlib.compress(record, 6, -zlib.MAX_WBITS)
    size = HEAD_SIZE + len(body) + 8
    told = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    return HEAD + SKIP + struct.pack("<II", *told) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def members(content: bytes) -> Iterator[tuple[int, int]]:
    """Start and size of each member of a normalised archive, by skipping from header to header."""
    at, end = 0, len(content)
    while at < end:
        if content[at] == 0:  # behind a long record
            at += 1
            continue
        if content[at : at + 10] != HEAD or content[at + 10 : at + 16] != SKIP:
            raise ValueError(f"no normalised member at {at}")
        size = struct.unpack_from("<I", content, at + 16)[0]
        if not size:
            unzip = zlib.decompressobj(31)
            unzip.decompress(memoryview(content)[at:])
            size = end - at - len(unzip.unused_data)
        yield at, size
        at += size


def record_bytes(head: dict[str, str], payload: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + BETWEEN.encode()


MEMBER = "archive string, seq int, member binary"
INDEX = "archive string, seq int, start bigint, size bigint, record_id string"
READ = "archive string, seq int, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def normalise(spark, path: str, out: str) -> None:
    """Rewrite whole-file gzip archives: each record its own gzip member, and an index beside them.

    ``out/archives/archive=<name>/`` holds one file an archive, ``out/index`` the rows
    ``archive, seq, start, size, record_id`` of where each member lies. A file isn't
    split, so the task that inflates an archive, once and as a stream, writes all of it:
    nothing is shuffled. The index is read off the files as they were written.

    A member ends with the top byte of its length, zero up to 16 MiB; the writer's line
    separator is that byte, so files hold members and nothing else (a longer record is
    followed by one zero, which gzip readers skip).
    """
    arrow = arrow_schema(spark, MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column("path")[r].as_py().rpartition("/")[2].removesuffix(".txt.gz")
                content = batch.column("content")[r].as_py()
                rows, held = [], 0
                for seq, (head, payload) in enumerate(parse(inflate(content))):
                    data = member(record_bytes(head, payload))
                    rows.append({"archive": name, "seq": seq, "member": data[:-1] if data[-1] == 0 else data})
                    held += len(data)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    # An empty file has no records; Spark writes one for an empty table.
    lines = files.where(F.length("content") > 0).mapInArrow(run, MEMBER).sortWithinPartitions("archive", "seq")
    lines.select(F.col("member").cast("string").alias("value"), "archive").write.option("lineSep", "\0").partitionBy("archive").text(f"{out}/archives")

    index_schema = arrow_schema(spark, INDEX)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in archives_of(batches):
            rows = [{"archive": name, "seq": k, "start": at, "size": size, "record_id": record_id_at(content, at)} for k, (at, size) in enumerate(members(content))]
            yield pa.RecordBatch.from_pylist(rows, schema=index_schema)

    archive_files(spark, f"{out}/archives").mapInArrow(located, INDEX).write.parquet(f"{out}/index")


def archive_files(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "/archive=([^/]+)/", 1).alias("archive"), "content")


def archives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column("archive")[r].as_py(), batch.column("content")[r].as_py()


def record_id_at(content: bytes, at: int) -> str | None:
    """The id of the record whose member starts there; inflates its headers only."""
    unzip, head = zlib.decompressobj(31), b""
    while b"\r\n\r\n" not in head and not unzip.eof:
        piece = unzip.decompress(unzip.unconsumed_tail or memoryview(content)[at:], 1024)
        if not piece:
            break
        head += piece
    fields = (x.partition(b":") for x in head.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
    return next((v.strip().decode("utf-8", "replace") for k, _, v in fields if k.strip().lower() == b"warc-record-id"), None)


def told(archive: str, seq: int, data: bytes, payloads: bool) -> dict:
    """What one member says of its page."""
    head, payload = next(parse(iter([zlib.decompress(data, 31)])))
    own = head["warc-type"] == "response"
    return {
        "archive": archive,
        "seq": seq,
        "record_id": head["warc-record-id"],
        "record_type": head["warc-type"],
        "target_uri": head.get("warc-target-uri") or None,
        "refers_to": head.get("warc-refers-to"),
        "payload_bytes": len(payload) if own else int(head["warc-payload-length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if own else head["warc-payload-digest"].removeprefix("sha256:"),
        "payload": payload if payloads else None,
    }


def in_batches(rows: Iterator[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row["payload"] or b"")
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, member by member, where the files are read.

    A response's digest and size are taken from the payload read; a revisit's are those
    of the record it refers to, as written. ``payload`` is null unless ``payloads``.
    """
    arrow = arrow_schema(spark, READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((told(name, k, content[at : at + size], payloads) for name, content in archives_of(batches) for k, (at, size) in enumerate(members(content))), arrow)

    return archive_files(spark, f"{path}/archives").mapInArrow(run, READ)


def read_records(spark, path: str, record_ids: DataFrame) -> DataFrame:
    """The records whose ids are in the first column of ``record_ids``, with payloads, each read at the place that the index gives.

    Only archives that hold one of them are read; each index line meets its archive in a
    join, so ask for few records of a large collection.
    """
    arrow = arrow_schema(spark, READ)
    wanted = record_ids.toDF(*(f"c{i}" for i in range(len(record_ids.columns)))).select(F.col("c0").alias("record_id")).distinct()
    index = spark.read.schema(INDEX).parquet(f"{path}/index").join(wanted, "record_id", "left_semi")
    lines = index.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "size"))).alias("lines"))
    both = archive_files(spark, f"{path}/archives").join(lines, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name, content, found in zip(*(batch.column(c) for c in ("archive", "content", "lines")), strict=True):
                    content = content.as_py()
                    for line in found.as_py():
                        yield told(name.as_py(), line["seq"], content[line["start"] : line["start"] + line["size"]], True)

        yield from in_batches(rows(), arrow)

    return both.mapInArrow(run, READ)


def _delete(spark, path: str) -> None:
    """Remove a folder of the shared file system that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def page_of(column: str):
    """The page id inside a record id; an empty one is null."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]*)>$', 1), '') as bigint)")


def archive_round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url") -> DataFrame:
    """Write all pages as WARC, normalise the archives, read them back: what each record says of its page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(with_revisits(pages, key, payload, url), f"{path}/whole", largest_payload(pages, payload))
    normalise(spark, f"{path}/whole", f"{path}/by-record")
    _delete(spark, f"{path}/whole")
    got = read_archives(spark, f"{path}/by-record")
    return got.select(page_of("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
