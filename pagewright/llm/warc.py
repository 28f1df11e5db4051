"""WARC archives: writing pages, normalising whole-file gzip to one member per record, reading by offset.

A file that is one gzip stream can be read from its start only. The normaliser inflates such a stream
once, writes every record as a gzip member of its own and notes where it lies in a sidecar index, after which
any record can be read alone. Records pass through in pieces, so memory doesn't grow with files or records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.files import located, new_file
from pagewright.session import materialize, new_folder

CHUNK = 1 << 20
# A writer starts another file when the records in one exceed this many bytes.
FILE_BYTES = 512 << 20
# Payloads of at least this size are stored once; smaller ones always.
REVISIT_MIN_BYTES = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # zlib's window bits for the gzip format


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base 32, as in WARC-Payload-Digest without its prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit that has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = payload_digest(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {revisit}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url or "") or "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    body = http if revisit else http + payload
    headers.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; `head` ends before the empty line."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class InflatedFile:
    """Bytes of a gzip file of one or many members, from start to end."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file = system.open_input_file(path)
        self.engine = zlib.decompressobj(GZIP)
        self.ready = bytearray()
        self.ended = False

    def _more(self) -> bool:
        while not self.ended:
            if self.engine.eof:
                data, self.engine = self.engine.unused_data or self.file.read(CHUNK), zlib.decompressobj(GZIP)
                if not data:
                    self.ended = True
                    return False
            else:
                data = self.engine.unconsumed_tail or self.file.read(CHUNK)
            got = self.engine.decompress(data, CHUNK)
            if not data and not got and not self.engine.eof:
                raise ValueError("gzip stream ends early")
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What lies before `mark`; None at the end of the file."""
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self._more():
                if self.ready.strip():
                    raise ValueError("record ends early")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes."""
        while size:
            if not self.ready and not self._more():
                raise ValueError("record ends early")
            piece = bytes(self.ready[:size])
            del self.ready[: len(piece)]
            size -= len(piece)
            yield piece


def normalise_file(source: str, target: str) -> int:
    """Rewrites one file with a member per record, its index as `<target>.idx`; number of records.

    The index has a JSON object per line: offset and length of the member, type, record id and URI.
    """
    reader = InflatedFile(source)
    system, path = located(target)
    count = at = 0
    with system.open_output_stream(path, compression=None) as out, system.open_output_stream(path + ".idx", compression=None) as index:
        while (head := reader.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            fields = parse_head(head)
            engine, begin = zlib.compressobj(6, zlib.DEFLATED, GZIP), at
            for piece in chain([head + b"\r\n\r\n"], reader.pieces(int(fields["content-length"])), [b"\r\n\r\n"]):
                out.write(packed := engine.compress(piece))
                at += len(packed)
            out.write(packed := engine.flush())
            at += len(packed)
            if b"".join(reader.pieces(4)) != b"\r\n\r\n":
                raise ValueError("record has a wrong length")
            line = {
                "offset": begin, "length": at - begin, "type": fields.get("warc-type"),
                "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
            }
            index.write(json.dumps(line).encode() + b"\n")
            count += 1
    return count


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and body of the record in one member."""
    data = zlib.decompress(file.read_at(length, offset), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


def planned_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """`(page_id, url, payload, refers_to, revisit)`: of equal payloads the smallest page id is the response.

    Null pages are empty payloads. Rows that repeat the smallest id of their group are responses too;
    a null id revisits the smallest known one, and is a response where none is known. Payloads are equal
    if their SHA-1 is. Only digests that occur more than once are stored and joined.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = own.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "refers_to"), "payloads")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return own.join(groups, "digest", "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Whole-file gzip archives of `planned_records`, `(path, records)` per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, done = TaskContext.get().partitionId(), None, []

        def close():
            out.write(engine.flush())
            out.close()
            done.append((name, count))

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    name, engine, count, size = new_file(folder, part, ".warc.gz"), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                    system, path = located(name)
                    out = system.open_output_stream(path, compression=None)
                data = record(*row)
                out.write(engine.compress(data))
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())})

    return materialize(records.mapInArrow(write, "path string, records long"), "archives")


def normalised(files: DataFrame, folder: str) -> DataFrame:
    """`files(path)` -> `(path, source, records)`: normalised copies with their indexes, a task per file."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = new_file(folder, part, ".warc.gz")
                yield pa.RecordBatch.from_pydict({"path": [target], "source": [source], "records": [normalise_file(source, target)]})

    spread = files.select("path").repartition(max(1, files.count()))
    return materialize(spread.mapInArrow(rewrite, "path string, source string, records long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """Records of normalised `files(path)`, each read by the offset in its index.

    `(page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, offset)`. The digest of a response is
    computed from its payload and must equal the recorded one; a revisit has both of the full payload recorded.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def rows(path: str) -> Iterator[tuple]:
        system, place = located(path)
        with system.open_input_stream(place + ".idx", compression=None) as stream:
            lines = stream.read().splitlines()
        file = system.open_input_file(place)
        for line in map(json.loads, lines):
            fields, body = read_member(file, line["offset"], line["length"])
            head, _, payload = body.partition(b"\r\n\r\n")
            digest, kind, size = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], len(payload)
            if kind == "revisit":
                size = int(parse_head(head)["content-length"])
            elif payload_digest(payload) != digest:
                raise ValueError(f"{path}: payload differs from its digest at {line['offset']}")
            yield (
                number(fields.get("x-page-id")), fields["warc-target-uri"], size, digest, kind,
                number(fields.get("x-refers-to-page-id")), path, line["offset"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                columns = list(zip(*rows(path))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    spread = files.select("path").repartition(max(1, files.count()))
    return spread.mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"
    )


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes, normalises and reads back `pages`; an empty table gives no files and no rows."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    whole = write_archives(planned_records(pages), f"{folder}/whole")
    return read_archives(normalised(whole, f"{folder}/members"))
