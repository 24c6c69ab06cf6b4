"""WARC archives: write, normalise and read back.

``write_archives`` streams records into whole-file gzip archives, as some
crawlers leave them: one gzip stream, no entry but its start.  ``normalise``
inflates each archive once, rewrites every record as its own gzip member and
writes a sidecar index with the offset and length of each.  ``read_records``
opens archives through the index, one member at a time.  Files go to the
shared folder under names that no other attempt uses; the table of a finished
step names the files that count, so a repeated task leaves only an unused file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import open_fs, save, shuffle_partitions
from seriesloom.session import new_table_path

LEAST = 1000  # bytes from which equal payloads are written once
CHUNK = 1 << 18
ROLL = 32 << 20  # payload bytes per archive file
LEVEL = 5
FILES = "path string, index_path string, records bigint"


def decide(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str | None, least: int = LEAST) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to), refers_to null for responses.

    Among rows of equal payloads of at least ``least`` bytes those with the
    largest id are responses, the others revisit it.  Only payloads that occur
    more than once are joined, by their digest.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        (F.col(url_col).cast("string") if url_col else F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = save(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), "keeper"),
        "warc-repeated",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(repeated, rows["digest"] == repeated["d"], "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )


def _text(value: str | None) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (b"" if revisit else payload)
    ident = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Target-URI: {_text(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str | None = None, *, roll: int = ROLL) -> DataFrame:
    """Table of files (path, index_path null, records), each one gzip stream over whole records."""
    folder = folder or new_table_path(records.sparkSession, "warc-in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, packer, name, count, size = None, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "index_path": pa.array([None], pa.string()), "records": [count]}
            )

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(packer.compress(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])))
                count, size = count + 1, size + len(r["payload"])
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return save(records.mapInArrow(run, FILES), "warc-files")


def inflate(stream) -> Iterator[bytes]:
    """Inflated chunks of a gzip file of one member or several, read once, with bounded memory."""
    unpack, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or stream.read(CHUNK)
        if not data:
            break
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        part = unpack.decompress(data, CHUNK)
        rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        if part:
            yield part
    if not unpack.eof:
        raise ValueError("the gzip stream is cut off")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, content block) of each record; only one record is held."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(chunks, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and fill(2) and held[:2] == b"\r\n"):
            del held[:2]
        if not held and not fill(1):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header is cut off")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("a record's content is cut off")
        block = bytes(held[end + 4 : end + 4 + size])
        headers[""] = bytes(held[: end + 4]).decode("utf-8", "replace")
        del held[: end + 4 + size]
        yield headers, block


def normalise(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Table of files (path, index_path, records): every record its own gzip member, with a sidecar index.

    The index has one JSON line per record: id, type, offset, length, digest.
    """
    folder = folder or new_table_path(files.sparkSession, "warc-out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, at = open_fs(path)
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                name, offset, count = uuid.uuid4().hex, 0, 0
                with (
                    source.open_input_stream(at, compression=None) as stream,
                    fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out,
                    fs.open_output_stream(f"{base}/{name}.cdxj", compression=None) as index,
                ):
                    for headers, block in split_records(inflate(stream)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(headers[""].encode() + block + b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        entry = {
                            "id": headers["warc-record-id"], "type": headers["warc-type"], "offset": offset,
                            "length": len(member), "digest": headers.get("warc-payload-digest"),
                        }
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict({
                    "path": [f"{folder}/{name}.warc.gz"], "index_path": [f"{folder}/{name}.cdxj"], "records": [count],
                })

    # One file a row: each is dealt to a task of its own.
    spread = files.repartition(shuffle_partitions(files.sparkSession), "path")
    return save(spread.mapInArrow(run, FILES), "warc-files")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _ident(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_records(files: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """One row per record of indexed archives; digests of stored payloads are computed anew and must agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(",")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = open_fs(path)
                ifs, iat = open_fs(index_path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(at) as file, ifs.open_input_stream(iat, compression=None) as lines:
                    entries = lines.read().splitlines()
                    for line in entries:
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        member = file.read(entry["length"])
                        headers, block = next(split_records(iter([zlib.decompress(member, 31)])))
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        refers = headers.get("warc-refers-to")
                        if refers is None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {entry['id']} differs from its digest")
                        size = int(headers["warc-payload-length"]) if refers else len(payload)
                        row = (_ident(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"],
                               _ident(refers) if refers else None, size, digest)
                        rows.append(row + ((payload,) if with_payload else ()))
                        held += len(payload)
                        if len(rows) >= 2000 or with_payload and held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spread = files.repartition(shuffle_partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def archive_roundtrip(
    pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
    least: int = LEAST,
) -> DataFrame:
    """Write, normalise and read back; one row per input row.

    Null payloads are empty.  Null ids are written as such; a null id is never
    a group's response unless all ids of the group are null (then all are).
    Repeated rows of the largest id are all responses.  Other columns are
    ignored.  An empty table gives an empty one.
    """
    decided = decide(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, least=least)
    return read_records(normalise(write_archives(decided)))
