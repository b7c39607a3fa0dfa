"""WARC archives: written by tasks into the shared folder, read back record by record.

Each record is a gzip member of its own. The reader goes through a file once from its beginning, inflates
piece by piece, takes the lengths of blocks from their headers and checks the digests while the bytes pass.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.batches import bodies, slices
from ledgerline.session import fresh_path, write_and_read

ID = "urn:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
LONGEST_HEADER = 1 << 20


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value in one line: control characters and blanks at the ends are percent-encoded."""
    return "".join(c if c.isprintable() or c == " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def info_record(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """A response, or a revisit of another page's response, which has the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``body``, ``refers_to``: the page whose response a page repeats, or null.

    Of pages with equal payloads of at least ``least_bytes`` bytes that with the smallest id is the response.
    Rows with that same id and payload are responses too; rows without an id are revisits where any other page
    has the payload, and responses otherwise. Payloads are compared by length and SHA-1. Only digests are
    grouped; the bytes move once, by page and digest, so that no frequent payload gathers in one task.
    """
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    digests = [F.sha1("body").alias("sha1"), F.length("body").cast("long").alias("size")]
    facts = write_and_read(read.select("page_id", *digests).where(F.col("size") >= least_bytes).distinct(), fresh_path(pages.sparkSession, "warc-facts"))
    groups = facts.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    revisits = facts.join(groups, ["sha1", "size"]).where("page_id IS NULL OR page_id != first").select("page_id", "sha1", "size", "first")
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("sha1").alias("of_sha1"), F.col("size").alias("of_size"), "first")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha1") == F.col("of_sha1")) & (F.col("size") == F.col("of_size"))
    return read.select("*", *digests).join(revisits, same, "left").select("page_id", "url", "body", F.col("first").alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the rows as WARC files and returns their list: ``path``, ``n_records``, ``n_bytes``.

    Each task writes files of its own with new names, begins another one at ``file_bytes``, and lists a file
    when it is complete. The list is stored, so what a lost or repeated task has left is in no list.
    ``folder`` is a URI that all executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = pyarrow.fs.FileSystem.from_uri(folder)
        path, out, n, size = "", None, 0, 0
        for batch in batches:
            for part in slices(batch):
                columns = (part.column(name).to_pylist() for name in ("page_id", "url", "refers_to"))
                for page_id, url, refers_to, body in zip(*columns, bodies(part), strict=True):
                    if out is None:
                        path, n = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{place}/{path}", compression=None)
                        size = out.write(info_record(date))
                    size += out.write(page_record(page_id, url, body, refers_to, date))
                    n += 1
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [size]})

    files, place = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    return write_and_read(marked.mapInArrow(run, "path string, n_records long, n_bytes long"), fresh_path(marked.sparkSession, "warc-list"))


class Members:
    """The gzip members of a stream, one after the other, in pieces of bounded size."""

    def __init__(self, read: Callable[[int], bytes]):
        self._read, self._left, self._inflate = read, b"", None

    def next_member(self) -> bool:
        """Goes to the beginning of the next member, past what is left of this one."""
        while self._inflate is not None and self.piece():
            pass
        self._left = self._left or self._read(CHUNK)
        self._inflate = zlib.decompressobj(16 + zlib.MAX_WBITS) if self._left else None
        return self._inflate is not None

    def piece(self) -> bytes:
        """More bytes of this member, none at its end."""
        while self._inflate is not None and not self._inflate.eof:
            self._left = self._inflate.unconsumed_tail or self._left or self._read(CHUNK)
            if not self._left:
                raise ValueError("the archive ends inside a record")
            out = self._inflate.decompress(self._left, CHUNK)
            self._left = self._inflate.unused_data if self._inflate.eof else self._inflate.unconsumed_tail
            if out:
                return out
        return b""


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(read: Callable[[int], bytes], keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive: headers, sizes, digests as they are found, and whether they are as announced.

    Blocks are hashed as they are inflated and kept only on demand. Raises ValueError where the file breaks off,
    a record does not begin with its version, or a block is not as long as announced.
    """
    members = Members(read)
    while members.next_member():
        head = b""
        while b"\r\n\r\n" not in head:
            more = members.piece()
            if not more or len(head) > LONGEST_HEADER:
                raise ValueError("a record has no end of its headers")
            head += more
        head, _, rest = head.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("a gzip member does not begin a record")
        warc = _headers(head)
        left = int(warc["content-length"])
        block, payload, http, n_payload, kept = hashlib.sha1(), hashlib.sha1(), None if "http" in warc.get("content-type", "") else b"", 0, []
        held = b""
        while left:
            piece = rest or members.piece()
            piece, rest = piece[:left], piece[left:]
            if not piece:
                raise ValueError("a block is shorter than announced")
            left -= len(piece)
            block.update(piece)
            if http is None:
                held += piece
                if b"\r\n\r\n" not in held:
                    if len(held) > LONGEST_HEADER:
                        raise ValueError("an HTTP header has no end")
                    continue
                http, _, piece = held.partition(b"\r\n\r\n")
            payload.update(piece)
            n_payload += len(piece)
            if keep_payload:
                kept.append(piece)
        tail = rest
        while more := members.piece():
            tail += more[: 8 - len(tail)]
        if tail != b"\r\n\r\n":
            raise ValueError("a block is longer than announced")
        found = base64.b32encode(payload.digest()).decode()
        told = warc.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = warc.get("warc-type") == "revisit"
        verified = warc.get("warc-block-digest", "sha1:").removeprefix("sha1:") in ("", base64.b32encode(block.digest()).decode())
        verified &= revisit or told in ("", found)
        length = _headers(http or b"").get("content-length")
        if revisit and length is not None:
            n_payload = int(length)
        elif http and length is not None and int(length) != n_payload:
            verified = False
        yield {"headers": warc, "payload_bytes": n_payload, "payload_digest": told if revisit else found, "verified": verified, "payload": b"".join(kept) if keep_payload else None}


def _page(urn: str | None) -> str | None:
    return (urn or "").strip("<>").removeprefix(ID) or None


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The page records of the listed archives, a task for some files, each read once from its beginning.

    ``page_id`` and ``refers_to`` (long, null where there is none), ``url``, ``record_type``, ``payload_bytes``,
    ``payload_digest``, ``verified``, and with ``with_payload`` the bytes, null for revisits. Those of a revisit
    are of the payload it stands for. Damaged files raise; wrong digests are reported in ``verified``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                source, path = pyarrow.fs.FileSystem.from_uri(uri)
                with source.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for record in read_records(stream.read, with_payload):
                        kind = record["headers"].get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        rows.append(record | {"kind": kind})
                        held += 300 + len(record["payload"] or b"")
                        if held > CHUNK * 16:
                            yield _rows(rows, with_payload)
                            rows, held = [], 0
                    yield _rows(rows, with_payload)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean" + ", payload binary" * with_payload
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, schema)


def _rows(records: list[dict], with_payload: bool) -> pa.RecordBatch:
    def number(name: str) -> pa.Array:
        found = (_page(record["headers"].get(name)) for record in records)
        return pa.array([None if page is None else int(page) for page in found], pa.int64())

    columns = {
        "page_id": number("warc-record-id"),
        "url": pa.array([record["headers"].get("warc-target-uri") for record in records], pa.string()),
        "record_type": pa.array([record["kind"] for record in records], pa.string()),
        "payload_bytes": pa.array([record["payload_bytes"] for record in records], pa.int64()),
        "payload_digest": pa.array([record["payload_digest"] for record in records], pa.string()),
        "refers_to": number("warc-refers-to"),
        "verified": pa.array([record["verified"] for record in records], pa.bool_()),
    }
    if with_payload:
        columns["payload"] = pa.array([None if record["kind"] == "revisit" else record["payload"] for record in records], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def through_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes each page as a record and reads the archives back; see `mark_revisits` and `read_archives`.

    A null html is an empty payload, a null url has no header. An empty table gives no archive and no rows.
    """
    folder = folder or _uri(fresh_path(pages.sparkSession, "warc"))
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder), with_payload)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
