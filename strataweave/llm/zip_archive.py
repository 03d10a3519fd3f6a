"""Operator 5: WARC records in ZIP-packaged archives, written and read back by byte ranges.

Writing: records of equal payload (by SHA-1 and length) become one response, that of the smallest ``page_id``, and revisit
records that refer to it. Each task writes one archive under a name of its own into the shared folder: stored ZIP members
``archive/data-*.warc.gz`` (one gzip stream for each record) and ``indexes/index-*.jsonl`` (place of each record in its member), then
the central directory, with ZIP64 fields where sizes, offsets or counts need them. The paths come back as a table, so archives of lost or repeated attempts are never read.

Reading: the end of an archive is range-read for its (ZIP64) end record, then the central directory, then the index members.
Index rows are dealt over tasks; each record is range-read from its stored member, neighbours together, and parsed. Nothing is
extracted, and no archive is read whole.

Null html is an empty payload; null urls give records without a target. Rows without a ``page_id`` are never chosen as a
response unless no other row has their payload; rows that repeat the smallest id are all responses. Characters outside
printable ASCII in urls are percent-encoded in the header. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import stage, staging_dir

#: Bytes of records in one stored member, and of neighbouring records fetched at once.
MEMBER_BYTES = 16 << 20
FETCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_ALL32, _ALL16 = 0xFFFFFFFF, 0xFFFF


def open_store(path: str):
    """File system and path for a folder or file that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class StoredZip:
    """Writes stored members to a stream and the central directory at its end; ``limit`` is where ZIP64 fields begin."""

    def __init__(self, out, limit: int = _ALL32, count_limit: int = _ALL16):
        self.out, self.at, self.members, self.limit, self.count_limit = out, 0, [], limit, count_limit

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Store a member; gives the offset of its first byte."""
        raw, start, crc = name.encode(), self.at, zlib.crc32(data)
        big = len(data) >= self.limit
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _ALL32 if big else len(data)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        first = self.at
        self._put(data)
        self.members.append((raw, crc, len(data), start))
        return first

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.members:
            fields = b""
            if size >= self.limit:
                fields += struct.pack("<QQ", size, size)
            if start >= self.limit:
                fields += struct.pack("<Q", start)
            extra = struct.pack("<HH", 1, len(fields)) + fields if fields else b""
            short, place = (_ALL32 if size >= self.limit else size), (_ALL32 if start >= self.limit else start)
            head = struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if fields else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, place)
            self._put(_CENTRAL + head + raw + extra)
        size, n = self.at - begin, len(self.members)
        if begin >= self.limit or size >= self.limit or n >= self.count_limit:
            end = self.at
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        low = lambda x, top: min(x, top)
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, low(n, _ALL16), low(n, _ALL16), low(size, _ALL32), low(begin, _ALL32) if begin < self.limit else _ALL32, 0))


def read_directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (header offset, size) of the stored members of an open archive, by range reads."""
    tail = min(size, 22 + _ALL16 + 20)
    data = file.read_at(tail, size - tail)
    at = data.rfind(_END, 0, max(0, len(data) - 18))  # the record is 22 bytes long
    while at >= 0 and at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data):
        at = data.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", data, at + 4)
    if at >= 20 and data[at - 20 : at - 16] == _LOCATOR:
        place = struct.unpack_from("<Q", data, at - 12)[0]
        end = file.read_at(56, place)
        if end[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, begin = struct.unpack_from("<QQQ", end, 32)
    listing = file.read_at(length, begin)
    members, at = {}, 0
    for _ in range(n):
        if listing[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", listing, at + 20)
        place = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + names].decode()
        extra = listing[at + 46 + names : at + 46 + names + extras]
        spot = 0
        while spot + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, spot)
            if kind == 1:
                values = list(struct.unpack_from(f"<{room // 8}Q", extra, spot + 4))
                full = values.pop(0) if full == _ALL32 else full
                packed = values.pop(0) if packed == _ALL32 else packed
                place = values.pop(0) if place == _ALL32 else place
            spot += 4 + room
        if method:
            raise ValueError(f"{name} is not stored")
        members[name] = (place, full)
        at += 46 + names + extras + notes
    return members


def member_start(file, place: int) -> int:
    """Offset of a member's first byte, from its local header."""
    head = file.read_at(30, place)
    if head[:4] != _LOCAL:
        raise ValueError("no local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return place + 30 + names + extras


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def warc_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header with the full payload's length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, payload and lengths of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return {"fields": fields, "payload": payload, "length": length}


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = target = archive = None
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        body, index, members = [], [], 0

        def flush():
            nonlocal body, index, members
            name = f"archive/data-{members:05d}.warc.gz"
            archive.add(name, b"".join(body))
            archive.add(f"indexes/index-{members:05d}.jsonl", "\n".join(json.dumps({"member": name, "offset": o, "length": n}) for o, n in index).encode())
            body, index, members = [], [], members + 1

        held = 0
        for batch in batches:
            for page, url, html, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                if archive is None:
                    store, target = open_store(path)
                    store.create_dir(os.path.dirname(target), recursive=True)
                    stream = store.open_output_stream(target)
                    archive = StoredZip(stream)
                record = gzip.compress(warc_record(page, url, (html or "").encode(), refers, revisit), 1, mtime=0)
                body.append(record)
                index.append((held, len(record)))
                held += len(record)
                if held >= MEMBER_BYTES:
                    flush()
                    held = 0
        if archive is not None:
            if body:
                flush()
            archive.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([archive.at])], ["path", "size"])

    return run


def write_archives(pages: DataFrame) -> DataFrame:
    """``path, size`` of the archives that hold one record for each row of ``pages(page_id, url, html)``."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(html)).withColumn("bytes", F.octet_length(html))
    first = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    copied = first.filter("copies > 1").select("digest", "bytes", "first")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False))
    marked = rows.join(copied, ["digest", "bytes"], "left").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    folder = f"{staging_dir(pages.sparkSession)}/{uuid.uuid4().hex}"
    return stage(marked.mapInArrow(_write(folder), "path string, size long"))


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record places from the index members of archives."""
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
            store, target = open_store(path)
            with store.open_input_file(target) as file:
                members = read_directory(file, size)
                starts = {name: member_start(file, place) for name, (place, _) in members.items()}
                for name, (_, length) in members.items():
                    if not name.startswith("indexes/"):
                        continue
                    rows = [json.loads(line) for line in file.read_at(length, starts[name]).splitlines()]
                    n = len(rows)
                    offset = np.array([starts[r["member"]] + r["offset"] for r in rows], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array(offset), pa.array([r["length"] for r in rows], pa.int64())], ["path", "offset", "length"]
                    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted places; neighbours within ``FETCH_BYTES`` come in one read."""
    kind = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
    )
    opened: dict = {}
    for batch in batches:
        places = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
        at, rows = 0, []
        while at < len(places):
            path, begin, _ = places[at]
            stop, to = at, begin
            while stop < len(places) and places[stop][0] == path and places[stop][1] == to and (stop == at or to + places[stop][2] - begin <= FETCH_BYTES):
                to += places[stop][2]
                stop += 1
            if path not in opened:
                for file in opened.values():
                    file.close()
                store, target = open_store(path)
                opened = {path: store.open_input_file(target)}
            data = opened[path].read_at(to - begin, begin)
            for _, offset, length in places[at:stop]:
                record = parse_record(gzip.decompress(data[offset - begin : offset - begin + length]))
                fields = record["fields"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = fields["WARC-Type"] == "response"
                own = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
                rows.append(
                    {
                        "page_id": _page(fields["WARC-Record-ID"]),
                        "url": fields.get("WARC-Target-URI"),
                        "payload_bytes": record["length"],
                        "payload_digest": digest,
                        "record_type": fields["WARC-Type"],
                        "refers_to": None if whole else _page(fields["WARC-Refers-To"]),
                        "intact": not whole or (own == digest and len(record["payload"]) == record["length"]),
                    }
                )
            at = stop
            if len(rows) >= 2_000:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)
    for file in opened.values():
        file.close()


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives ``path, size``, by range reads.

    ``intact`` tells whether a response's payload has the digest and length of its header.
    """
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = archives.repartition(parts, "path").mapInArrow(_list, "path string, offset long, length long")
    chunk = F.floor(F.col("offset") / FETCH_BYTES)
    dealt = listed.repartition(parts, "path", chunk).sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    return dealt.mapInArrow(_fetch, schema)
