"""WARC archives: a writer, and a sequential reader with one gzip member a record.

The reader inflates a file piece by piece and never holds more than a record: header lines up to the blank line, then
Content-Length bytes of block, then the closing blank lines; block and payload digests are verified. Which records
revisit others is decided on slim rows (digest, id); a hot digest is one row a task before it is shuffled.

Defined results: a null payload is empty; a null url is written as urn:unknown, control characters in it are escaped; of
rows that repeat the largest page_id of a digest, all are responses; null page_ids come back as null and are responses;
an empty table gives no archive and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import broadcast_if_small, new_path

_READ = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks its framing or a digest."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _escaped(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:unknown")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_escaped(url)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """Of a file, per gzip member an iterator over its inflated pieces; to be used up before the next member."""
    pending = stream.read(_READ)
    while pending:
        unpack = zlib.decompressobj(31)
        state = {"rest": pending, "over": False}

        def pieces(unpack=unpack, state=state):
            data = state["rest"]
            while True:
                out = unpack.decompress(data, _READ)
                if out:
                    yield out
                if unpack.eof:
                    break
                data = unpack.unconsumed_tail or stream.read(_READ)
                if not data:
                    raise WarcError("the file ends within a gzip member")
            state["rest"], state["over"] = unpack.unused_data or stream.read(_READ), True

        yield pieces()
        if not state["over"]:
            raise WarcError("a member was left before its end")
        pending = state["rest"]


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of the one record in a member, framed by Content-Length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a record ends within its header")
        held += piece
    version, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version[:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    del held[: end + 4]
    if not (found := fields.get("content-length", "")).isdecimal():
        raise WarcError("a record without a Content-Length")
    size = int(found)
    for piece in pieces:
        held += piece
        if len(held) > size + 4:
            raise WarcError("a record goes on after its block")
    if len(held) != size + 4 or held[size:] != b"\r\n\r\n":
        raise WarcError("a block's length differs from Content-Length")
    return fields, bytes(held[:size])


def records(stream) -> Iterator[dict]:
    """The verified records of one archive, in order: fields, payload (None for revisits), payload length and digest."""
    for pieces in members(stream):
        fields, block = read_record(pieces)
        if _sha1(block) != fields.get("warc-block-digest", _sha1(block)):
            raise WarcError(f"block digest of {fields.get('warc-record-id')}")
        http, _, payload = block.partition(b"\r\n\r\n")
        if lacking := {"warc-type", "warc-payload-digest"} - set(fields):
            raise WarcError(f"a record without {', '.join(sorted(lacking))}")
        kind = fields["warc-type"]
        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        if not said.get(b"content-length", b"").isdigit():
            raise WarcError("a payload without a Content-Length")
        declared = fields["warc-payload-digest"]
        if kind == "response":
            if _sha1(payload) != declared:
                raise WarcError(f"payload digest of {fields.get('warc-record-id')}")
        elif payload:
            raise WarcError("a revisit with a payload")
        yield {"fields": fields, "kind": kind, "payload": payload if kind == "response" else None, "size": int(said[b"content-length"]), "digest": base64.b32decode(declared[5:]).hex()}


def _number(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn[10:-1] else None


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, refers_to of every page that repeats the payload of the page with the largest id."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.where(F.octet_length("html") >= min_bytes).where("page_id is not null").select("page_id", F.sha1(data).alias("digest"), F.octet_length("html").alias("size"))
    first = slim.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    return slim.join(first, ["digest", "size"]).where("page_id < refers_to").select(F.col("page_id").alias("_id"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, max_file_bytes: int = 256 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row (page_id, url, html) to archives in folder; returns the manifest (path, n_records, n_bytes).

    A task writes files under names of its own attempt and lists them in the manifest only when they are complete, and
    Spark commits the manifest of one attempt, so lost executors and repeated tasks leave no record twice."""
    spark = pages.sparkSession
    revisits = plan_revisits(pages, min_bytes)
    rows = pages.select("page_id", "url", "html").join(broadcast_if_small(revisits), F.col("page_id") == F.col("_id"), "left").drop("_id")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        context = TaskContext.get()
        out, path, n, size, done = None, None, 0, 0, []
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path = f"{root}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                data = encode_record(page_id, url, (html or "").encode("utf-8"), refers, date, level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= max_file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    manifest = new_path(spark, "manifest") if folder is None else f"{folder}/manifest"
    rows.mapInArrow(write, "path string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.schema("path string, n_records long, n_bytes long").parquet(manifest)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives: page_id, url, payload (binary, null for revisits), payload_bytes, payload_digest,
    record_type, refers_to. One task streams one or more whole files."""
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in records(stream):
                        f = r["fields"]
                        rows.append((_number(f.get("warc-record-id")), f.get("warc-target-uri"), r["payload"], r["size"], r["digest"], r["kind"], _number(f.get("warc-refers-to"))))
                        held += len(r["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    files = manifest.count()
    return manifest.repartition(max(1, files), "path").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write every page and read the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
