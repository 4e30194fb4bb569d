"""Media columns: payloads as lossless images in archives, read back by a custom Spark data source.

Writing: each task stores its payloads as 8-bit grey PNG members of ZIP archives of bounded size, in the shared folder, under names that no
other attempt has. What a task has stored is its result, a row for each archive, and these rows are written as the table `manifest` beside
the archives: archives of lost or speculative attempts are in no manifest, and no reader sees them.

Reading: the data source takes the archives from the manifest (from the listing, where a folder has none), cuts each into byte ranges, and gives every range to a task, which reads the
archive's directory, takes the members whose headers begin in its range, and streams their bytes in Arrow batches. A member
that fails is read again by its own offset; after the last try its row carries the error instead of stopping the scan.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.llm.common import Scratch, text_bytes

WIDTH = 576
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
MANIFEST = "archive string, size long, members long"
SCHEMA = "archive string, member string, header_offset long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 255 appended up to a positive multiple of unit."""
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def encode_png(samples: bytes, level: int = 3) -> bytes:
    """8-bit grey image, WIDTH samples a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made; every chunk's checksum is verified. Other images raise ValueError."""
    if data[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body += part
        at += n + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and deviation (in 256ths), a 16-bin histogram (0 to 255 of the largest bin) and a 64-bit average hash."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x >> 4, minlength=16)
    cells = x.reshape(64, -1).mean(axis=1)
    bits = int.from_bytes(np.packbits(cells > x.mean()).tobytes(), "big")
    return f"mean={int(x.mean() * 256)};std={int(x.std() * 256)};hist={(hist * 255 // hist.max()).astype(np.uint8).tobytes().hex()};hash={bits:016x}"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names of S3 count as s3."""
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def write_archives(rows: DataFrame, folder: str, name_col: str, data_col: str, archive_bytes: int = 32 << 20) -> int:
    """Store data_col (binary) of each row as a PNG member; returns the number of members.

    A member's name is the row's place in its task's partition, a slash and name_col as text ("null" where null). Null data counts as empty. Memory: one
    archive a task. A folder takes one such write.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store_fs, root = open_store(folder)
        store_fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        total = begun = made = 0
        buffer, archive = io.BytesIO(), None

        def flush() -> pa.RecordBatch:
            nonlocal archive, buffer, made, begun
            archive.close()
            name = f"part-{part:06d}-{made:04d}-{attempt}.zip"
            with store_fs.open_output_stream(f"{root}/{name}") as f:
                f.write(buffer.getbuffer())
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([buffer.tell()], pa.int64()), pa.array([total - begun], pa.int64())], ["archive", "size", "members"])
            made, begun, buffer, archive = made + 1, total, io.BytesIO(), None
            return row

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                if archive is None:
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED, allowZip64=True)
                archive.writestr(zipfile.ZipInfo(f"{part}-{total}/{name.as_py()}", (1980, 1, 1, 0, 0, 0)), encode_png(pad(data.as_py() or b"")))
                total += 1
                if buffer.tell() >= archive_bytes:
                    yield flush()
        if archive is not None:
            yield flush()

    named = rows.select(F.coalesce(F.col(name_col).cast("string"), F.lit("null")).alias("name"), F.col(data_col).alias("data"))
    named.mapInArrow(store, MANIFEST).write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.sum("members")).first()[0] or 0


class ArchiveRange(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


class ArchiveSource(DataSource):
    """Options: path (folder of ZIP archives, as a URI), range_bytes, batch_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class _Tail(io.RawIOBase):
    """Seekable view of a remote archive for zipfile: only what it asks for is read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        data = self.file.read_at(n, self.at)
        self.at += len(data)
        return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from the manifest or the listing alone; the archives' own directories are read by the tasks."""
        store, root = open_store(self.uri)
        if store.get_file_info(f"{root}/manifest").type == fs.FileType.Directory:
            rows = parquet.read_table(f"{root}/manifest", filesystem=store, columns=["archive", "size"])
            archives = sorted((f"{root}/{a}", n) for a, n in zip(rows["archive"].to_pylist(), rows["size"].to_pylist()))
        else:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            archives = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".zip"))
        return [ArchiveRange(p, n, a, min(a + self.range_bytes, n)) for p, n in archives for a in range(0, n, self.range_bytes)] or [ArchiveRange("", 0, 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_store(self.uri)
        names, offsets, bodies, errors, held = [], [], [], [], 0
        with store.open_input_file(partition.path) as file:
            members = [m for m in zipfile.ZipFile(_Tail(file, partition.size)).infolist() if partition.begin <= m.header_offset < partition.end]
        for m in members:
            body, error = self._member(store, partition.path, m)
            names.append(m.filename)
            offsets.append(m.header_offset)
            bodies.append(body)
            errors.append(error)
            held += len(body or b"")
            if held >= self.batch_bytes:
                yield self._batch(partition.path, names, offsets, bodies, errors)
                names, offsets, bodies, errors, held = [], [], [], [], 0
        if names:
            yield self._batch(partition.path, names, offsets, bodies, errors)

    def _member(self, store: fs.FileSystem, path: str, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """Bytes of one member by its offset, its checksum verified; tried again by itself."""
        error = None
        for k in range(self.tries):
            try:
                file = self._open(store, path)
                head = file.read_at(30, m.header_offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member header here")
                name, extra = struct.unpack_from("<HH", head, 26)
                body = file.read_at(m.compress_size, m.header_offset + 30 + name + extra)
                if m.compress_type != zipfile.ZIP_STORED:
                    body = zlib.decompress(body, -15)
                if len(body) != m.file_size or zlib.crc32(body) != m.CRC:
                    raise ValueError("checksum")
                return body, None
            except (OSError, ValueError, zlib.error, struct.error) as x:
                error = f"{type(x).__name__}: {x}"
                self._close()
                time.sleep(0.05 * 2**k)
        return None, error

    def _open(self, store: fs.FileSystem, path: str):
        if getattr(self, "_at", None) != path:
            self._close()
            self._file, self._at = store.open_input_file(path), path
        return self._file

    def _close(self) -> None:
        if getattr(self, "_at", None):
            self._file.close()
        self._at = None

    @staticmethod
    def _batch(path: str, names: list, offsets: list, bodies: list, errors: list) -> pa.RecordBatch:
        arrays = [pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(bodies, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["archive", "member", "header_offset", "media", "error"])


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A row for each member: archive, member, header_offset, media, error (null where the read went well)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(**options).load(folder)


def features_udf():
    """media to its decoded payload's facts. n_bytes: UTF-8 holds no byte 255, so padding is what is stripped."""

    @F.arrow_udf("struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
    def facts(media: pa.Array) -> pa.Array:
        rows = []
        for m in media:
            m = m.as_py()
            p = decode_png(m)
            rows.append((len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        cols = zip(*rows) if rows else [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return facts


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text in archives under folder and return what is read back, a row for each row of docs: id,
    archive, member, header_offset, media, error.

    Null or empty text: one unit of padding. Null ids stay null; repeated rows are members each; equal texts give equal
    media. Other columns stay out. An empty table gives no archive and no rows. A member that can't be read has a null media and its error.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_bytes(text_col).alias("__data"))
    write_archives(rows, folder, "__id", "__data")
    back = read_archives(docs.sparkSession, folder)
    name = F.substring_index("member", "/", -1)
    return back.select(name.try_cast("long").alias(id_col), "archive", "member", "header_offset", "media", "error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = media_columns(docs, f"{Scratch(spark, 'media').root}/archives")
    whole = F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.concat(F.col("member"), F.lit(": "), F.col("error"))))
    return back.select("doc_id", features_udf()(whole).alias("f")).select("doc_id", "f.*")
