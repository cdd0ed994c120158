"""WARC archives: one gzip member per record, written and read back by Spark tasks.

Archives lie in a folder that all executors reach. A task writes its own archives under names
no other attempt uses and hands back the names; only those of the attempt that Spark counts
are read. Reading goes record by record through incremental decompression, so memory holds
one record, not one archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.sizing import broadcast_if_small
from docloom.session import new_folder, with_checkpoints

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
ARCHIVE_BYTES = 64 << 20
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
ARCHIVES = "path string, n_records long"
RECORDS = (
    "record_id string, record_type string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, payload binary, valid boolean"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One uncompressed record. A revisit holds the HTTP head only; its digest and length are the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", None if uri is None else quote(uri, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", f"<{refers_to}>" if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(raw) + packer.flush()


class _Members:
    """Bytes of a stream of gzip members; each member is read on its own."""

    def __init__(self, stream):
        self.stream, self.packed = stream, b""

    def open(self) -> bool:
        """Goes to the next member; False at the end of the archive."""
        self.unpacker, self.plain = zlib.decompressobj(16 + zlib.MAX_WBITS), bytearray()
        if not self.packed:
            self.packed = self.stream.read(CHUNK)
        return bool(self.packed)

    def _more(self) -> bool:
        if self.unpacker.eof:
            return False
        if not self.packed:
            self.packed = self.stream.read(CHUNK)
        ended = not self.packed
        plain = self.unpacker.decompress(self.packed, CHUNK)
        if ended and not plain and not self.unpacker.eof:
            raise ValueError("an archive ends inside a record")
        self.plain += plain
        self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("a record's head has no end")
        out = bytes(self.plain[:end])
        del self.plain[: end + 2]
        return out

    def exactly(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.plain[:size])
        del self.plain[:size]
        return out

    def finish(self) -> None:
        """The member must end with the two line ends that close a record."""
        while self._more():
            if len(self.plain) > 4:
                break
        if bytes(self.plain) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        if not line:
            return out
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream) -> Iterator[dict]:
    """The records of one archive in order, as rows of RECORDS.

    valid tells whether block and payload have the digests their head states. A damaged frame
    (no version line, wrong length, broken compression) raises.
    """
    members = _Members(stream)
    while members.open():
        if members.line() != VERSION:
            raise ValueError("not a WARC record")
        head = _fields(iter(members.line, None))
        block = members.exactly(int(head["content-length"]))
        members.finish()
        start = block.find(b"\r\n\r\n")
        http = _fields(iter([*block[:start].split(b"\r\n")[1:], b""]))
        payload = block[start + 4 :]
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        whole = head["warc-type"] == "response"
        valid = head["warc-block-digest"] == f"sha1:{digest(block)}"
        if whole:
            valid &= digest(payload) == stated and len(payload) == int(http["content-length"])
        yield {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
            "target_uri": head.get("warc-target-uri"),
            "payload_digest": stated,
            "payload_bytes": int(http["content-length"]),
            "payload": payload if whole else None,
            "valid": valid,
        }


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class _Writer:
    """Writes records to archives of about ARCHIVE_BYTES each."""

    folder: str
    archive_bytes: int

    def __post_init__(self):
        self.store, self.base = _place(self.folder)
        self.store.create_dir(self.base, recursive=True)
        self.out, self.path, self.size, self.number = None, "", 0, 0

    def write(self, packed: bytes) -> Iterator[tuple[str, int]]:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.path, self.size, self.number = f"{self.folder.rstrip('/')}/{name}", 0, 0
            self.out = self.store.open_output_stream(f"{self.base.rstrip('/')}/{name}", compression=None)
        self.out.write(packed)
        self.size += len(packed)
        self.number += 1
        if self.size >= self.archive_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple[str, int]]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.path, self.number


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, n_records of the archives written, one or more a task.

    rows: record_id, record_type (response or revisit), refers_to, target_uri, payload (binary,
    null counts as empty). The names are cut off from the writing by a checkpoint, so nothing is
    written twice; files of attempts that failed are not in the list.
    """
    with_checkpoints(rows.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = _Writer(folder, archive_bytes)
        for batch in batches:
            done = []
            columns = (batch[c] for c in ("record_id", "record_type", "refers_to", "target_uri", "payload"))
            for record_id, kind, refers_to, uri, payload in zip(*columns, strict=True):
                raw = record(kind, record_id, uri, bytes(payload) if payload is not None else b"", refers_to)
                done += writer.write(member(raw))
            yield pd.DataFrame(done, columns=["path", "n_records"])
        yield pd.DataFrame(list(writer.close()), columns=["path", "n_records"])

    columns = rows.select("record_id", "record_type", "refers_to", "target_uri", "payload")
    return columns.mapInPandas(write, ARCHIVES).checkpoint()


def read_archives(archives: DataFrame, columns: list[str] | None = None, rows_at_once: int = 256) -> DataFrame:
    """The records (RECORDS, or some of its columns) of all archives listed by path, read in sequence."""
    wanted = columns or [c.split()[0] for c in RECORDS.split(", ")]
    kinds = dict(c.split() for c in RECORDS.split(", "))
    tasks = max(1, archives.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, name = _place(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows = []
                    for row in records(stream):
                        rows.append([row[c] for c in wanted])
                        if len(rows) >= rows_at_once:
                            yield pd.DataFrame(rows, columns=wanted)
                            rows = []
                    yield pd.DataFrame(rows, columns=wanted)

    spread = archives.select("path").repartition(min(tasks, 10_000))
    return spread.mapInPandas(read, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows for write_archives from pages (page_id, url, html), and page_id.

    Of pages with equal payloads (the html in UTF-8, null as empty) of at least min_bytes bytes,
    the one with the largest page_id is the response and the others revisit it; where rows repeat
    that page_id, or none has an id, each of them is a response. Smaller payloads are responses.
    Equality is that of SHA-1 and length; one payload that a third of all pages share is counted
    before the shuffle; payloads that occur once take no part in the join back, and the others are
    broadcast where their measured number allows it. Null urls give no target.
    """
    with_checkpoints(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    newest = (
        rows.filter(F.length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
        .filter("n > 1 and newest is not null")
        .select("sha1", "newest")
        .checkpoint()
    )
    joined = rows.join(broadcast_if_small(newest), "sha1", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(
        "page_id",
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, name(F.col("newest"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        "payload",
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives of all pages.

    A record whose digests do not hold ends the job.
    """
    archives = write_archives(with_revisits(pages, min_bytes), new_folder(pages.sparkSession, "warc"))
    back = read_archives(
        archives, ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "valid"]
    )
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("none")).cast("bigint")
    checked = F.when(F.col("valid"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a digest does not hold")))
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        checked.alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
