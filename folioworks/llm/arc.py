"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import IO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import locate, place
from .tables import scratch_dir, stored

# Fixed values of the two header lines: the fields of a record, in order.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
FILE_BYTES = 64_000_000
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_STAMP = "20200101000000"
_ids = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    """A WARC identifier that depends on the page alone, so that repeated tasks agree."""
    return f"<urn:uuid:{uuid.uuid5(_ids, f'page:{page_id}')}>"


def _member(data: bytes) -> bytes:
    """One gzip member, as both formats store a record."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


# ---- ARC ---------------------------------------------------------------------


def arc_header(version: int, name: str) -> bytes:
    body = f"{version} 0 folioworks\n{' '.join(FIELDS[version])}\n\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": _STAMP, "Content-type": "text/plain",
           "Filename": name}
    return arc_line(version, own, len(body)) + body + b"\n"


def arc_line(version: int, values: dict[str, str], length: int) -> bytes:
    values = values | {"Archive-length": str(length)}
    return (" ".join(quote(values.get(f) or "-", safe=":/?#[]@!$&'()*+,;=-._~%") for f in FIELDS[version]) + "\n").encode()


def arc_record(version: int, name: str, page_id: int, url: str | None, payload: bytes) -> bytes:
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {page_id}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    values = {"URL": quote(url or f"urn:page:{page_id}", safe=":/?#[]@!$&'()*+,;=-._~%"), "IP-address": "0.0.0.0",
              "Archive-date": _STAMP, "Content-type": "text/html", "Result-code": "200", "Offset": "0", "Filename": name}
    return arc_line(version, values, len(head) + len(payload)) + head + payload + b"\n"


def version_block(stream: IO[bytes]) -> tuple[int, str, str]:
    """Version, name and date that the first record states; it also lists the fields of
    the header lines that follow, which must be those of its version."""
    first = stream.readline().split()
    if not first or not first[0].startswith(b"filedesc://"):
        raise ValueError("no version block")
    block = stream.read(int(first[-1])).decode("utf-8", "replace").split("\n")
    version, fields = int(block[0].split()[0]), block[1].split()
    if fields != FIELDS.get(version):
        raise ValueError(f"unknown ARC version {version} with fields {fields}")
    return version, first[0].decode("utf-8", "replace").removeprefix("filedesc://"), first[2].decode("utf-8", "replace")


def read_arc(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header values and block of every record but the version block.

    A record's block is as long as its line declares.
    """
    return _records(stream, FIELDS[version_block(stream)[0]])


def _records(stream: IO[bytes], fields: list[str]) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        values = dict(zip(fields, line.decode("utf-8", "replace").rstrip("\n").split(" "), strict=True))
        length = int(values["Archive-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a record of {length} bytes ends after {len(block)}")
        yield values, block


def _http(block: bytes) -> tuple[bytes, int, bytes]:
    """HTTP head, page id and payload of a stored response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"x-page-id":
            return head + b"\r\n\r\n", int(value), payload
    raise ValueError("a response without page id")


# ---- WARC --------------------------------------------------------------------


def _date(stamp: str) -> str:
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"


def _record(lines: list[tuple[str, str]], body: bytes) -> bytes:
    lines = [*lines, ("WARC-Block-Digest", f"sha1:{sha1(body)}"), ("Content-Length", str(len(body)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + body + b"\r\n\r\n"


def info_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ids, f'file:{name}')}>"


def warc_info(version: int, name: str, stamp: str, target: str) -> bytes:
    """The ``warcinfo`` record equivalent to a version block."""
    body = f"software: folioworks\r\nformat: WARC File Format 1.0\r\ndescription: {name}, ARC version {version}\r\n".encode()
    return _record([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", info_id(target)), ("WARC-Date", _date(stamp)),
        ("WARC-Filename", target), ("Content-Type", "application/warc-fields")], body)


def warc_record(values: dict[str, str], block: bytes, refers_to: int | None, target: str) -> bytes:
    """The WARC record equivalent to an ARC record, in the archive ``target``; a
    revisit keeps the HTTP head only."""
    head, page_id, payload = _http(block)
    body = block if refers_to is None else head
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", values["URL"]), ("WARC-Date", _date(values["Archive-date"])),
        ("WARC-Warcinfo-ID", info_id(target)),
        ("WARC-IP-Address", values["IP-address"]), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                  ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    return _record(lines, body)


def read_warc(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        values = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            values[key] = value.strip()
        length = int(values["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield values, block


class _Unzipped(io.RawIOBase):
    """The members of a gzip file as one stream."""

    def __init__(self, source: IO[bytes]):
        self.source, self.inner, self.rest, self.ready = source, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            if not self.rest:
                self.rest = self.source.read(1 << 18)
                if not self.rest:
                    return 0
            self.ready = self.inner.decompress(self.rest, 1 << 20)
            if self.inner.eof:
                self.rest, self.inner = self.inner.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.inner.unconsumed_tail
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _opened(path: str) -> IO[bytes]:
    fs, name = locate(path)
    return io.BufferedReader(_Unzipped(fs.open_input_stream(name, compression=None)), 1 << 20)


# ---- jobs --------------------------------------------------------------------


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """File the pages in ARC archives of about ``FILE_BYTES``, one version or the
    other in turn; returns (path, records).

    A file's name comes from its partition, so a repeated task replaces its own
    files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size, n
            name = f"pages-{part:06d}-{number:04d}.arc.gz"
            version = 1 + (part + number) % 2
            place(f"{folder}/{name}", lambda out: out.write(b"".join([_member(arc_header(version, name)), *held])))
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})
            number, held, size, n = number + 1, [], 0, 0
            return row

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                version = 1 + (part + number) % 2
                record = arc_record(version, f"pages-{part:06d}-{number:04d}.arc.gz", page_id, url, (html or "").encode())
                held.append(_member(record))
                size, n = size + len(held[-1]), n + 1
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    pages = pages.filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return pages.mapInArrow(run, "path string, records long")


def arc_contents(arcs: DataFrame) -> DataFrame:
    """(path, page_id, digest, length) of every record, without the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as stream:
                    rows = [(path, page, sha1(payload), len(payload))
                            for _, block in read_arc(stream) for _, page, payload in [_http(block)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows]) for k in range(4)], ["path", "page_id", "digest", "length"])

    return arcs.select("path").mapInArrow(run, "path string, page_id long, digest string, length long")


def choose_responses(contents: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest page of the same payload, null for that page
    itself and for payloads under ``least_bytes``."""
    first = contents.filter(F.col("length") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return contents.join(first, "digest", "left").select(
        "path", "page_id", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def convert(decisions: DataFrame, folder: str) -> DataFrame:
    """Write each ARC archive as a WARC archive; returns (path, records), the records
    without the ``warcinfo`` that stands for the version block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        path = key[0].as_py()
        refers = dict(zip(table.column("page_id").to_pylist(), table.column("refers_to").to_pylist()))
        target = f"{path.rsplit('/', 1)[-1].removesuffix('.arc.gz')}.warc.gz"
        n = 0

        def fill(out: IO[bytes]) -> None:
            nonlocal n
            with _opened(path) as stream:
                version, name, stamp = version_block(stream)
                out.write(_member(warc_info(version, name, stamp, target)))
                for values, block in _records(stream, FIELDS[version]):
                    out.write(_member(warc_record(values, block, refers[_http(block)[1]], target)))
                    n += 1

        place(f"{folder}/{target}", fill)
        return pa.table({"path": [f"{folder}/{target}"], "records": [n]})

    # By number of tasks: small rows, much work; adaptive execution would merge them.
    return _spread(decisions, "path").groupBy("path").applyInArrow(run, "path string, records long")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """(page_id, url, warc_date, record_id, record_type, refers_to, payload_bytes,
    payload_digest, intact) of every record; a response's length and digest are
    those of the bytes read, ``intact`` says that the header agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as stream:
                    rows = [_read_back(values, block) for values, block in read_warc(stream) if values["WARC-Type"] != "warcinfo"]
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return warcs.select("path").mapInArrow(
        run, "page_id long, url string, warc_date string, record_id string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, intact boolean")


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("intact", pa.bool_()),
])


def _read_back(values: dict[str, str], block: bytes) -> dict:
    _, page_id, payload = _http(block)
    declared = values["WARC-Payload-Digest"].removeprefix("sha1:")
    row = {"page_id": page_id, "url": values["WARC-Target-URI"], "warc_date": values["WARC-Date"],
           "record_id": values["WARC-Record-ID"], "record_type": values["WARC-Type"], "refers_to": None,
           "payload_bytes": len(payload), "payload_digest": declared}
    whole = values["WARC-Block-Digest"] == f"sha1:{sha1(block)}"
    if values["WARC-Type"] == "revisit":
        refers_to = int(values["X-Refers-To-Page"])
        row |= {"refers_to": refers_to, "payload_bytes": int(values["X-Payload-Length"]),
                "intact": whole and values["WARC-Refers-To"] == record_id(refers_to)}
    else:
        digest = sha1(payload)
        row |= {"payload_digest": digest, "intact": whole and digest == declared}
    return row


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC to WARC and back, see :func:`read_warcs`.

    Bytes are moved by no shuffle: only ids, digests and lengths are.  A null
    page is an empty payload, a null url becomes ``urn:page:<id>``; rows
    without page id are left out; repeated rows of the smallest page id of a
    payload are all responses.
    """
    base = scratch_dir(pages.sparkSession)
    arcs = stored(write_arcs(pages, f"{base}/arc"), f"{base}/arcs")
    decisions = choose_responses(stored(arc_contents(_spread(arcs)), f"{base}/contents"), least_bytes)
    return read_warcs(_spread(stored(convert(decisions, f"{base}/warc"), f"{base}/warcs")))


def _spread(files: DataFrame, *by: str) -> DataFrame:
    """Spread short rows that stand for files over tasks, whatever the rows' own bytes."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
