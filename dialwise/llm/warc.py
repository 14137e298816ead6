"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME`` bytes; a bundle is a file of
such frames that ends with a seek table, itself a skippable frame, in the public seekable format: any
Zstandard reader sees one plain WARC stream, and a reader that knows the footer jumps to a frame. The
writer returns an index that maps each record's identifier to its file, frame, and offset and length in
the frame; one record is read by fetching and decompressing its frame alone.

Of records with equal payloads one is a ``response`` with the payload; the others are ``revisit``
records that refer to it and hold the same HTTP head without the payload. Equal payloads are found by
SHA-256. Only digests are shuffled for that, added up before the shuffle; the largest groups of copies
(at most ``HOT``) are broadcast and settled where their rows are read, the others are joined by digest.

Each task writes files of its own under names that no other attempt uses; only those in the index, which
is written once the tasks are done, belong to the archive, so a lost or repeated task leaves nothing but
an unused file. Bundles are written and read through ``pyarrow.fs`` in the shared folder.

Defined cases: a null payload is empty, and empty payloads are equal; of rows that also repeat the id,
one is the response; a null id is smaller than any other; a null URL is ``urn:x-unknown``, and characters
that a URI can't hold are percent-encoded; a record longer than a frame has a frame of its own; an empty
table gives an archive without files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.llm.common import filled
from dialwise.session import frozen, new_table_path

#: Uncompressed bytes of a frame, compressed bytes of a bundle and of what a task reads, groups of copies
#: that are broadcast.
FRAME, BUNDLE, TASK, HOT = 1 << 20, 64 << 20, 4 << 20, 50_000
LEVEL = 3

#: The seekable format's skippable frame, footer, and the WARC profile of a revisit.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The archive's own namespace for record identifiers.
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-dialwise:warc")
_DATE = "1970-01-01T00:00:00Z"

_INDEX = (
    "record_id string, page_id long, record_type string, file string, frame int, frame_start long,"
    " frame_bytes long, offset long, length long"
)
_INDEX_FIELDS = [
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()),
    ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()),
    ("length", pa.int64()),
]
_RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary"
)
_RECORD_FIELDS = [
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()),
]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records.


def record_id(row: int, page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{row}:{page_id}')}"


def record(row: int, page_id, url, payload: bytes, kept_row: int, kept_id, kept_url) -> tuple[str, str, bytes]:
    """(identifier, type, bytes) of one record; a revisit if ``kept_row`` is another row."""
    own, digest = record_id(row, page_id), base32_sha1(payload)
    revisit = kept_row != row
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: <{record_id(kept_row, kept_id)}>",
            f"WARC-Refers-To-Target-URI: {_uri(kept_url)}",
        ]
        if kept_id is not None:
            head.append(f"X-Refers-To-Page-Id: {kept_id}")
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return own, "revisit" if revisit else "response", whole


def _uri(url: str | None) -> str:
    return "urn:x-unknown" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def parsed(raw: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` as a row of ``_RECORD``, and where the next one starts.

    The digests of the block and of a response's payload are checked.
    """
    end = raw.index(b"\r\n\r\n", start)
    lines = raw[start:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {start}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != head["WARC-Block-Digest"]:
        raise ValueError(f"the block of {head['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    number = lambda name: int(head[name]) if name in head else None
    row = {
        "record_id": head["WARC-Record-ID"][1:-1], "page_id": number("X-Page-Id"),
        "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"),
        "payload": None if revisit else payload,
    }
    return row, end + 4 + int(head["Content-Length"]) + 4


# Bundles.


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, uncompressed) bytes of each frame."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, uncompressed bytes) of each frame, from the end of an open file."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    table, start, frames = file.read(count * width), 0, []
    for i in range(count):
        packed, whole = struct.unpack_from("<II", table, i * width)
        frames.append((start, packed, whole))
        start += packed
    return frames


def _opened(path: str):
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class _Bundle:
    """A file being written: frames, and the index rows of the records in them."""

    def __init__(self, folder: str, frame: int):
        self.frame = frame
        self.path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        system, name = pafs.FileSystem.from_uri(self.path)
        self.out = system.open_output_stream(name, compression=None)
        self.frames, self.index, self.size = [], [], 0
        self.held, self.held_bytes, self.waiting = [], 0, []

    def add(self, page_id, own: str, kind: str, whole: bytes) -> None:
        if self.held and self.held_bytes + len(whole) > self.frame:
            self.end_frame()
        self.waiting.append((own, page_id, kind, self.held_bytes, len(whole)))
        self.held.append(whole)
        self.held_bytes += len(whole)

    def end_frame(self) -> None:
        if not self.held:
            return
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.held))
        self.out.write(packed)
        at = len(self.frames)
        self.index += [
            {
                "record_id": own, "page_id": page_id, "record_type": kind, "file": self.path, "frame": at,
                "frame_start": self.size, "frame_bytes": len(packed), "offset": offset, "length": length,
            }
            for own, page_id, kind, offset, length in self.waiting
        ]
        self.frames.append((len(packed), self.held_bytes))
        self.size += len(packed)
        self.held, self.held_bytes, self.waiting = [], 0, []

    def close(self) -> pa.RecordBatch:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return pa.RecordBatch.from_pylist(self.index, pa.schema(_INDEX_FIELDS))


def _write_bundles(folder: str, frame: int, size: int):
    def run(batches):
        bundle = None
        for batch in batches:
            for row, page_id, url, payload, kept_row, kept_id, kept_url in zip(
                *(c if k == 3 else c.to_pylist() for k, c in enumerate(batch.columns))
            ):
                bundle = bundle or _Bundle(folder, frame)
                content = payload.as_buffer().to_pybytes()
                bundle.add(page_id, *record(row, page_id, url, content, kept_row, kept_id, kept_url))
                if bundle.size >= size:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


def _kept(pages: DataFrame, least: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(digest, kept) of the payloads of ``least`` bytes or more that occur more than once, kept being
    the (page_id, row, url) that stays: the most frequent ones, at most ``hot``, and the others.

    ``row`` counts down in the choice, so that of equal ids the first row stays.
    """
    first = F.struct("page_id", (-F.col("row")).alias("back"), "url")
    groups = (
        pages.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max(first).alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "kept", "n")
    )
    groups = frozen(groups, "copies")
    top = groups.orderBy(F.desc("n"), "digest").limit(hot).drop("n")
    top = frozen(top, "hot-copies")
    return top, groups.drop("n").join(F.broadcast(top.select("digest")), "digest", "left_anti")


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 0, hot: int = HOT, frame: int = FRAME, bundle: int = BUNDLE,
) -> DataFrame:
    """Write a record per row to bundles in ``folder`` and return the index.

    Records of equal payloads of ``least`` bytes or more are one response (largest id) and revisits.
    """
    payload = filled(payload_col).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    rows = frozen(rows, "payloads")
    top, others = _kept(rows, least, hot)
    found = rows.join(F.broadcast(top), "digest", "left")
    if not others.isEmpty():
        # Payloads that may still have copies meet their group by digest; no group here is a large one.
        settled = found.where(F.col("kept").isNotNull() | (F.col("size") < least))
        open_ = found.where(F.col("kept").isNull() & (F.col("size") >= least)).drop("kept")
        found = settled.unionByName(open_.join(others, "digest", "left"))
    copy = F.col("kept").isNotNull() & (F.col("size") >= least)
    ready = found.select(
        "row", "page_id", "url", "payload",
        F.when(copy, -F.col("kept.back")).otherwise(F.col("row")).alias("kept_row"),
        F.when(copy, F.col("kept.page_id")).alias("kept_id"),
        F.when(copy, F.col("kept.url")).alias("kept_url"),
    )
    system, name = pafs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)
    return frozen(ready.mapInArrow(_write_bundles(folder, frame, bundle), _INDEX), "index")


def _read_frames(batches) -> Iterator[pa.RecordBatch]:
    """Frames (file, start, bytes) to their records."""
    schema, unzip = pa.schema(_RECORD_FIELDS), zstandard.ZstdDecompressor()
    opened = (None, None)
    for batch in batches:
        for path, start, size in zip(*(c.to_pylist() for c in batch.columns)):
            if opened[0] != path:
                opened = (path, _opened(path))
            opened[1].seek(start)
            raw = unzip.decompress(opened[1].read(size))
            rows, at = [], 0
            while at < len(raw):
                row, at = parsed(raw, at)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)


def _list_frames(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _opened(path) as file:
                frames = read_seek_table(file)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(frames), pa.string()),
                    pa.array([f[0] for f in frames], pa.int64()),
                    pa.array([f[1] for f in frames], pa.int64()),
                ],
                names=["file", "start", "bytes"],
            )


def read_archive(files: DataFrame) -> DataFrame:
    """All records of the bundles named in ``files`` (column ``file``), a task's work being some frames.

    The seek tables at the ends of the files say where the frames are. A row of them is small and
    stands for much work, so the number of tasks follows the bytes of the frames.
    """
    frames = files.select("file").distinct().mapInArrow(_list_frames, "file string, start long, bytes long")
    frames = frozen(frames, "frames")
    size, count = frames.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(count, size // TASK + 1))
    return frames.repartition(tasks, "file", "start").mapInArrow(_read_frames, _RECORD)


def _fetch(batches) -> Iterator[pa.RecordBatch]:
    schema, unzip = pa.schema(_RECORD_FIELDS), zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for path, start, size, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            with _opened(path) as file:
                file.seek(start)
                raw = unzip.decompress(file.read(size))
            rows.append(parsed(raw[offset : offset + length])[0])
            if len(rows) == 64:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose identifiers are in ``wanted`` (column ``record_id``), each from its own frame."""
    rows = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    places = rows.select("file", "frame_start", "frame_bytes", "offset", "length")
    return places.mapInArrow(_fetch, _RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the archive of ``pages`` below the shared folder, and read all of its records back."""
    index = write_archive(pages, new_table_path(spark, "warc"), **options)
    return read_archive(index)
