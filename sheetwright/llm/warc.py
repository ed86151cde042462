"""WARC archives: write, normalise monolithic gzip to one member a record, and read back by a sidecar offset index.

Archives are ``.warc.gz`` files in a folder that all executors share, in any store that Arrow's file systems reach; tables
only list them.  A file is written under a hidden name and then moved, so a task that is run again replaces its own files.

``write_archives`` makes archives whose gzip stream spans the whole file, as many crawlers do.  ``normalise`` inflates
such a stream once, in bounded pieces, cuts it into records, writes each record as a gzip member of its own and a
sidecar ``.idx`` with offset, length, type and id of every member, one a line.  ``read_records`` opens members at the
offsets that the sidecars state, by ranged reads, and nothing else.

Payloads that occur again are stored once: of equal payloads of at least ``MIN_REVISIT`` bytes the row with the
smallest id is a ``response``, the others are ``revisit`` records that name it and carry no payload.

Defined results: a null payload counts as empty; rows that repeat both id and payload are the same capture and all
are responses; a null id never is the smallest where another is known, and its record has an identifier of its own kind;
an empty table gives no archive and an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, look_up, parallelism

#: Payloads below this many bytes are stored again each time.
MIN_REVISIT = 100
#: An archive is closed once it holds so many bytes before compression; bytes read at once, and at least by a ranged read.
ARCHIVE_BYTES = 64 << 20
CHUNK, WINDOW = 1 << 18, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTED = "archive string, records long, bytes long"
INDEX = "archive string, offset bigint, length bigint, record_type string, record_id string"
RECORDS = "archive string, offset bigint, length bigint, record_id string, record_type string, refers_to string, target string, payload_bytes bigint, payload_digest string, payload binary"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "", 1))


class Sink:
    """A file that appears under its name only once it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, root = store(folder)
        self.store.create_dir(root, recursive=True)
        self.spare, self.path = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}", f"{root}/{name}"
        self.file, self.size = self.store.open_output_stream(self.spare, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.store.move(self.spare, self.path)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def urn(record_id: str | None) -> str:
    """The identifier of a row's record, its id written so that any text is one word; rows without an id share one."""
    return "<urn:x-page-without-id>" if record_id is None else f"<urn:x-page:{quote(record_id, safe='')}>"


def id_of(identifier: str) -> str | None:
    """The row's id in an identifier that ``urn`` made."""
    return None if identifier == urn(None) else unquote(identifier.strip("<>").removeprefix("urn:x-page:"))


def make_record(record_id: str | None, record_type: str, target: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {urn(record_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_one_line(target)}"] if target else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"] if record_type == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(record: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record, by lower-case name, and where its block begins."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of the pieces of a gzip file of one or more members, at most ``WINDOW`` at once."""
    inflater, some = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            some = True
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            yield inflater.decompress(piece, WINDOW)
            piece = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
    while some and not inflater.eof and (rest := inflater.decompress(b"", WINDOW)):
        yield rest
    if some and not inflater.eof:
        raise ValueError("the gzip stream is cut short")


def cut(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; holds one record and one chunk at a time."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                headers, start = parse_head(bytes(held[: end + 4]))
                need = start + int(headers["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the last record is cut short")


def repack(pieces: Iterable[bytes], level: int = 6) -> Iterator[tuple[bytes, str, str]]:
    """One gzip member a record, with its type and identifier, from the pieces of a gzip file."""
    for record in cut(inflate(pieces)):
        headers, _ = parse_head(record)
        yield zlib.compress(record, level, wbits=31), headers["warc-type"], headers["warc-record-id"]


def read_member(member: bytes) -> dict:
    """The record in one member: its headers' fields, its payload and the payload's size and digest.

    A response's digest is taken from its payload and must equal the one that its header states.
    """
    record = zlib.decompress(member, wbits=31)
    headers, start = parse_head(record)
    block = record[start : start + int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if headers["warc-type"] == "response":
        if (found := hashlib.sha256(payload).hexdigest()) != stated or len(payload) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged: {found}")
    refers_to = headers.get("warc-refers-to")
    return {
        "record_id": id_of(headers["warc-record-id"]), "record_type": headers["warc-type"], "refers_to": id_of(refers_to) if refers_to else None, "target": headers.get("warc-target-uri", ""),
        "payload_bytes": size, "payload_digest": stated, "payload": payload,
    }


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, payload_col: str, target_col: str, min_revisit: int) -> DataFrame:
    """(record_id, record_type, refers_to, target, payload, payload_bytes, payload_digest) for each row.

    Payloads are grouped by digest in a narrow table; only rows that the bounded filter marks are shuffled whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(target_col, F.lit("")).alias("target"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = scratch.table(rows.drop("payload"), "narrow")
    firsts = narrow.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = look_up(narrow, firsts.where("n > 1 and first is not null"), "payload_digest", "n", narrow.count()).drop("n")
    revisits = again.where("first is not null and (id is null or id <> first)")
    revisits = scratch.table(revisits.withColumn("__key__", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), "payload_digest")), "revisits")
    keyed = rows.withColumn("__key__", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), "payload_digest"))
    split = KeyFilter(revisits.select("__key__"), "__key__", revisits.count()).split(keyed, "__key__")
    unsure = split.where("__maybe__").join(revisits.select("__key__").distinct(), "__key__", "left_anti")
    names = ["id", "target", "payload", "payload_bytes", "payload_digest"]
    responses = split.where("not __maybe__").select(*names).union(unsure.select(*names))
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string")})
    again = revisits.select("id", "target", F.lit("").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").cast("string").alias("refers_to"))
    return responses.unionByName(again).withColumn("record_id", F.col("id").cast("string")).drop("id")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Monolithic archives of planned records: each task packs its rows into gzip files of one stream each, and lists them."""

    def pack(batches):
        task = TaskContext.get().partitionId()
        sink, squeezer, size, count, serial = None, None, 0, 0, 0

        def closed():
            sink.write(squeezer.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{serial:05d}.warc.gz"]), pa.array([count]), pa.array([sink.size])], names=["archive", "records", "bytes"])

        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    sink, squeezer = Sink(folder, f"pages-{task:06d}-{serial:05d}.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31)
                record = make_record(r["record_id"], r["record_type"], r["target"], r["payload_digest"], r["payload_bytes"], r["payload"].encode("utf-8", "surrogatepass"), r["refers_to"], date)
                sink.write(squeezer.compress(record))
                size, count = size + len(record), count + 1
                if size >= archive_bytes:
                    yield closed()
                    sink, size, count, serial = None, 0, 0, serial + 1
        if sink is not None:
            yield closed()

    return records.mapInArrow(pack, LISTED)


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Each listed archive of ``source`` rewritten in ``folder`` with one gzip member a record, and its sidecar; lists them."""

    def pieces(name):
        own, root = store(source)
        with own.open_input_stream(f"{root}/{name}", compression=None) as file:
            while piece := file.read(CHUNK):
                yield piece

    def work(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                sink, lines = Sink(folder, name), []
                for member, kind, identifier in repack(pieces(name)):
                    lines.append(f"{sink.size}\t{len(member)}\t{kind}\t{identifier}\n")
                    sink.write(member)
                sink.close()
                sidecar = Sink(folder, name + ".idx")
                sidecar.write("".join(lines).encode())
                sidecar.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)]), pa.array([sink.size])], names=["archive", "records", "bytes"])

    return archives.mapInArrow(work, LISTED)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The members that the sidecars of a folder state: (archive, offset, length, record_type, record_id)."""
    found = spark.read.text(f"{folder}/*.idx").select(F.regexp_replace("_metadata.file_name", r"\.idx$", "").alias("archive"), F.split("value", "\t").alias("f"))
    cells = {"offset": "bigint", "length": "bigint", "record_type": "string", "record_id": "string"}
    return found.select("archive", *(F.get("f", F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(cells.items())))


class Archive:
    """Ranged reads of one archive: neighbouring members are read together, up to ``WINDOW`` bytes at once."""

    def __init__(self, folder: str, name: str):
        own, root = store(folder)
        self.file, self.name = own.open_input_file(f"{root}/{name}"), name
        self.start, self.held = 0, b""

    def read(self, offset: int, length: int) -> bytes:
        at = offset - self.start
        if not 0 <= at <= len(self.held) - length:
            self.start, at = offset, 0
            self.held = self.file.read_at(max(length, WINDOW), offset)
        return self.held[at : at + length]


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every member of an index (archive, offset, length, ...), each opened at its own offset in the archives of ``folder``."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def work(batches):
        archive = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = []
                for m in batch.slice(at, 1000).to_pylist():
                    if archive is None or archive.name != m["archive"]:
                        archive = Archive(folder, m["archive"])
                    record = read_member(archive.read(m["offset"], m["length"]))
                    found.append(record | m | {"record_id": record["record_id"], "payload": record["payload"] if with_payload else None})
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds.get(k, pa.string())) for k in names], names=names)

    return index.select("archive", "offset", "length").mapInArrow(work, RECORDS)


def round_trip(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", target_col: str = "url", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write an archive record per row, normalise the archives and read every record back by the sidecars."""
    id_type = pages.schema[id_col].dataType.simpleString()
    records = plan_records(pages, scratch, id_col, payload_col, target_col, min_revisit)
    source, folder = scratch.path("monolithic"), scratch.path("normalised")
    written = scratch.table(write_archives(records, source, archive_bytes), "written")
    n = written.count()
    if not n:
        return pages.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")
    listed = scratch.table(normalise(written.repartition(min(n, 4 * parallelism(pages.sparkSession))), source, folder), "listed")
    scratch.drop("monolithic", "narrow", "revisits")
    if listed.agg(F.sum("records")).first() != written.agg(F.sum("records")).first():
        raise RuntimeError("records were lost between archives")
    found = read_records(read_index(pages.sparkSession, folder), folder, with_payload=False)
    return found.select(F.col("record_id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
