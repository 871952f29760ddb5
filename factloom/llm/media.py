"""Media columns: payloads as lossless PNG images in tar archives, and a Spark data source that reads them.

``write_archives`` lets each task write one tar of its rows' images, with an index of member offsets
beside it. A retried or speculative task writes files of its own; only the names that finished tasks
report stand in the directory's manifest. ``MemberArchives`` (format ``member_archives``) plans
partitions as byte ranges over the archives of a directory. A member belongs to the range in which its
header starts, so ranges need no talk with each other. Members are read by offset, each with its own
retries; one that stays unreadable becomes a row with ``error`` set. Payloads leave as Arrow batches of a few MB.

Paths are opened through pyarrow.fs (file, hdfs, s3, gs). Defined cases: a null text is empty and has
one row of spaces as its image; a null doc_id is kept as null; repeated rows are written as often as
they occur, with equal images; other columns are dropped; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.llm import scratch

WIDTH = 192
MANIFEST = "_MANIFEST"
_PNG = b"\x89PNG\r\n\x1a\n"
_BATCH = 4 << 20
_MEMBER = "archive string, offset long, name string, size long, payload binary, error string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey samples, row by row; the data are padded with spaces to whole rows (one at least),
    and their own length stands in a text chunk."""
    rows = max(1, -(-len(data) // width))
    lines = np.zeros((rows, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data.ljust(rows * width, b" "), np.uint8).reshape(rows, width)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows, width) of an image of ``encode_png`` and the length before padding."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, packed, size, shape = 8, [], None, None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of 8-bit grey samples")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a row has a filter")
    samples = np.ascontiguousarray(lines[:, 1:])
    return samples, samples.size if size is None else size


def feature(samples: np.ndarray) -> str:
    """Mean and mean step in 1/256, the share of each high nibble in 1/255, and a 64-bit hash of which
    of 8 x 8 areas are brighter than their right neighbour; all in hex, from whole numbers only."""
    flat = samples.ravel().astype(np.int64)
    mean = int(flat.sum()) * 256 // flat.size
    step = int(np.abs(np.diff(flat)).sum()) * 256 // max(1, flat.size - 1)
    shares = np.bincount(flat >> 4, minlength=16) * 255 // flat.size
    rows = np.linspace(0, samples.shape[0], 9).astype(int)
    sums = np.array([samples[a : max(a + 1, b)].sum(0, dtype=np.int64) for a, b in zip(np.minimum(rows[:-1], samples.shape[0] - 1), rows[1:], strict=True)])
    areas = np.add.reduceat(sums, np.arange(8) * (samples.shape[1] // 8), axis=1)
    bits = np.packbits((areas > np.roll(areas, -1, axis=1)).ravel())
    return f"{mean:04x}{step:04x}{shares.astype(np.uint8).tobytes().hex()}{bits.tobytes().hex()}"


def _header(name: str, size: int) -> bytes:
    head = name.encode().ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + (b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")) + b"%011o\0" % 0 + b" " * 8 + b"0" + b"\0" * 100 + b"ustar\00000" + b"\0" * 247
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _write(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.tar"
        fs, root = pafs.FileSystem.from_uri(directory)
        index, at, out = [], 0, None
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                image = encode_png((text.as_buffer().to_pybytes() if text.is_valid else b""))
                out.write(_header(f"{len(index):09d}_{'null' if doc is None else doc}.png", len(image)))
                out.write(image + b"\0" * (-len(image) % 512))
                index.append((at, len(image)))
                at += 512 + -(-len(image) // 512) * 512
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as side:
                side.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"archive": [name], "members": [len(index)], "bytes": [at + 1024]})

    return run


def write_archives(docs: DataFrame, directory: str) -> int:
    """Writes the texts of ``docs`` (doc_id, text) as images into archives under ``directory``, a uri
    that all executors reach, and their names into its manifest. Returns the number of members."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(_write(directory), "archive string, members long, bytes long").collect()  # a row a task
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write("".join(f"{r.archive}\t{r.bytes}\n" for r in sorted(done)).encode())
    return sum(r.members for r in done)


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes, self.tries = int(options.get("rangebytes", 8 << 20)), int(options.get("tries", 3))

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                found = [(n, int(s)) for n, _, s in (x.partition("\t") for x in f.read().decode().splitlines())]
        else:
            found = sorted((i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".tar"))
        return [ByteRange(n, a, a + self.range_bytes) for n, size in found for a in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = pafs.FileSystem.from_uri(self.uri)
        path = f"{root}/{partition.archive}"
        with fs.open_input_stream(f"{path}.idx") as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        index = index[(index[:, 0] >= partition.start) & (index[:, 0] < partition.end)]
        rows, held, file = [], 0, None
        for offset, size in index.tolist():
            for left in reversed(range(self.tries)):
                try:
                    file = file or fs.open_input_file(path)
                    raw = file.read_at(512 + size, offset)
                    head, payload, error = raw[:512], raw[512:], None
                    if len(raw) != 512 + size or head[257:262] != b"ustar" or int(head[148:154], 8) != sum(head[:148]) + 256 + sum(head[156:]):
                        raise OSError(f"no member at {offset} of {path}")
                    break
                except OSError as e:
                    head, payload, error, file = b"", None, str(e), None
                    if left:
                        time.sleep(0.2)
            rows.append((partition.archive, offset, head[:100].rstrip(b"\0").decode() or None, size, payload, error))
            held += size
            if held >= _BATCH:
                yield _members(rows)
                rows, held = [], 0
        if rows:
            yield _members(rows)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _MEMBER.split(", ")])


class MemberArchives(DataSource):
    """Members of the tar archives in the directory ``path``. Options: rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "member_archives"

    def schema(self) -> str:
        return _MEMBER

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, image, error in zip(batch.column("name").to_pylist(), batch.column("payload"), batch.column("error").to_pylist(), strict=True):
            if error:
                raise OSError(error)
            image = image.as_buffer().to_pybytes()
            samples, size = decode_png(image)
            payload = samples.tobytes()
            doc = name.rpartition("_")[2].removesuffix(".png")
            rows.append((None if doc == "null" else int(doc), size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], [c.split()[0] for c in _FEATURES.split(", ")])


def media_features(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """Stores the texts of ``docs`` as images, reads them back by the data source and gives a row of
    digests and features for each."""
    spark = docs.sparkSession
    directory = directory or scratch.new_path(spark, "media")
    write_archives(docs, directory)
    spark.dataSource.register(MemberArchives)
    return spark.read.format("member_archives").load(directory).mapInArrow(_decode, _FEATURES)
