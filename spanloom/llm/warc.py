"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, with a seek table in a skippable frame at
its end (the published seekable format: compressed and decompressed size of each frame, number of frames, magic
number).  An index maps each record to bundle, frame and offset inside the decompressed frame, so a record is read by
fetching the seek table and one frame.

Records of equal payloads of at least ``min_bytes``: that with the largest id is a ``response``, the others are
``revisit`` records that refer to it.  Smaller payloads are always stored.

Writing is a Spark job: each task writes bundles of its own, of at most about ``bundle_bytes``, under names that no
other attempt uses, in the shared folder, and gives back their index rows.  The index is committed by Spark, so what a
lost or repeated task left behind is named nowhere.

Cases: a null payload is empty; a null id has no number in its record's name and never is the largest; rows of equal
id and payload are all responses if that id is the largest; a null URL leaves its header out; line breaks in a URL are
percent-encoded; an empty table makes no bundle and an empty index; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import new_path, partitions, written
from spanloom.llm.textnp import releasing

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
#: Up to so many groups of equal payloads (about 60 bytes each) are broadcast to the writers.
BROADCAST_GROUPS = 200_000
INDEX = "record_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


class BundleWriter:
    """Collects records into frames of about ``frame_bytes`` and writes them to a stream."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.limit, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.buffer, self.frames, self.written, self.waiting = io.BytesIO(), [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it."""
        if self.buffer.tell() and self.buffer.tell() + len(record) > self.limit:
            self.flush()
        at = self.buffer.tell()
        self.buffer.write(record)
        return len(self.frames), at

    def flush(self) -> None:
        if self.buffer.tell():
            packed = self.zstd.compress(self.buffer.getvalue())
            self.out.write(packed)
            self.frames.append((self.written, len(packed), self.buffer.tell()))
            self.written += len(packed)
            self.buffer = io.BytesIO()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", c, d) for _, c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed size) of each frame, from the end of a file that can be read at any place."""
    end = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of this file")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read_at(8 * n, end - 9 - 8 * n)):
        out.append((at, c, d))
        at += c
    return out


def record(kind: str, record_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    cut = raw.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in raw[:cut].decode().split("\r\n")[1:])
    block = raw[cut + 4 : cut + 4 + int(fields["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:]), block[cut + 4 :]


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").removeprefix(URN)
    return int(digits) if digits else None


def _with_kind(pages: DataFrame, id_col: Column, payload: Column, min_bytes: int, broadcast_groups: int) -> DataFrame:
    """record_id, url, payload, digest, refers_to (null: a response).

    Groups of equal payloads are broadcast if they are few.  If not, those with more rows than the ``broadcast_groups``-th part
    of all are (they are fewer than that), so none of the payloads that are then shuffled on their digest is frequent.
    """
    rows = pages.select(id_col.cast("long").alias("record_id"), F.col("url"), F.coalesce(F.encode(payload, "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    groups = rows.where(large).groupBy("digest").agg(F.max("record_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1"), "equal-payloads")
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    if size.groups <= broadcast_groups:
        rows = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        hot = F.col("n") * broadcast_groups > size.rows
        rows = rows.join(F.broadcast(groups.where(hot).drop("n")), "digest", "left")
        open_ = large & F.col("largest").isNull()
        others = rows.where(open_).drop("largest").join(groups.where(~hot).drop("n"), "digest", "left")
        rows = rows.where(~open_).unionByName(others)
    other = ~F.col("record_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull() & large
    return rows.select("record_id", "url", "payload", "digest", F.when(other, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, bundle_bytes: int = 1 << 28, frame_bytes: int = 1 << 18, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write a record for each row to bundles in ``folder`` (a URI that all executors reach); gives back the index."""
    rows = _with_kind(pages.withColumnRenamed(url, "url") if url != "url" else pages, F.col(f"`{id_col}`"), F.col(f"`{payload}`"), min_bytes, broadcast_groups)
    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out = bundle = name = None
        made: list[tuple[int | None, int, int, int]] = []

        def index() -> pa.RecordBatch:
            bundle.close()
            out.close()
            f = bundle.frames
            columns = [[r[0] for r in made], [name] * len(made), [r[1] for r in made], [f[r[1]][0] for r in made], [f[r[1]][1] for r in made], [r[2] for r in made], [r[3] for r in made]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "bundle", "frame", "frame_at", "frame_bytes", "at", "bytes"])

        for batch in batches:
            for rid, target, raw, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    bundle, made = BundleWriter(out, frame_bytes), []
                made_of = record("response" if refers is None else "revisit", rid, target, raw, bytes.fromhex(digest), refers)
                made.append((rid, *bundle.add(made_of), len(made_of)))
                if bundle.written >= bundle_bytes:
                    yield index()
                    bundle = None
        if bundle is not None:
            yield index()

    return written(rows.mapInArrow(releasing(write), INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names: record_id, payload_bytes, payload_digest, record_type, refers_to.

    Each frame is fetched once, by the task that has its records.  A response's digest is computed from what was read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        zstd, now, frame, name, f, table = zstandard.ZstdDecompressor(), None, b"", None, None, []
        for batch in batches:
            made = []
            for bundle, k, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, f = bundle, fs.open_input_file(f"{root}/{bundle}")
                    table = seek_table(f)
                if (bundle, k) != now:
                    begin, packed, _ = table[k]
                    now, frame = (bundle, k), zstd.decompress(f.read_at(packed, begin))
                fields, http, payload = parse(frame[at : at + size])
                kind = fields["WARC-Type"]
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                refers = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                made.append((_number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers))
            if made:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = index.select("bundle", "frame", "at", "bytes").repartition(partitions(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return rows.mapInArrow(releasing(read), "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark, name: str = "warc") -> str:
    """A new folder under the shared one, as a URI."""
    path = new_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
