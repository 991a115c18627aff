"""Media columns: payloads as 8-bit audio members of archives, behind a custom Spark data source.

``format("loomgrid_archive")`` writes Arrow batches of (key, payload) into zip
archives, one wave file (8-bit PCM, mono) a member, and reads them again. The
writer rolls archives at a size, so an archive's directory is bounded; each job
that commits lists its archives in a manifest of its own, so jobs may append to
a path (overwriting drops the earlier manifests), and what failed or repeated
tasks have left is not read. The reader plans byte ranges over the listed
archives from their sizes alone, larger ones for more data, so that their number
stays bounded; a task reads its archives' directories, takes the members that
begin in its range, streams them in Arrow batches bounded by bytes, and reads a
member that fails its checksum or its read again by its own offset, without
touching the others.

Paths may name any store that pyarrow.fs knows.

Defined results: null text counts as empty; a payload is at least one block of
64 zero bytes; repeated rows are members of their own; a null doc_id stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import textbytes as tb
from .workspace import new_path, tune

NAME = "loomgrid_archive"
BLOCK = 64
MANIFEST = "_archives-"
#: Fixed values of the zip and wave formats.
_LOCAL, _CENTRAL, _END = "<4sHHHHHIIIHH", "<4sHHHHHHIIIHHHHHII", "<4sHHHHIIH"
WAVE_HEADER, RATE = 44, 8000
#: An archive ends at so many bytes or members; a planned range and a batch have so many bytes.
ARCHIVE_BYTES, ARCHIVE_MEMBERS, RANGE_BYTES, BATCH_BYTES = 32 << 20, 60_000, 8 << 20, 2 << 20
#: About so many ranges are planned at most; beyond, they are longer than RANGE_BYTES.
MOST_RANGES = 100_000
TRIES, WAIT_S = 3, 0.2


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def wave(samples: bytes) -> bytes:
    """A wave file of unsigned 8-bit samples; their number must be even."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a wave file of this format")
    return media[WAVE_HEADER : WAVE_HEADER + struct.unpack("<I", media[40:44])[0]]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


@dataclass
class Committed(WriterCommitMessage):
    archives: list[tuple[str, int]]


class _Archive:
    """One zip archive that is being written."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.name = f"{uuid.uuid4().hex}.zip"
        self.out = fs.open_output_stream(f"{folder}/{self.name}")
        self.at, self.directory = 0, []

    def add(self, member: str, media: bytes) -> None:
        name, crc = member.encode(), zlib.crc32(media)
        deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = deflate.compress(media) + deflate.flush()
        self.directory.append(struct.pack(_CENTRAL, b"PK\1\2", 20, 20, 0x800, 8, 0, 0x21, crc, len(body), len(media), len(name), 0, 0, 0, 0, 0, self.at) + name)
        head = struct.pack(_LOCAL, b"PK\3\4", 20, 0x800, 8, 0, 0x21, crc, len(body), len(media), len(name), 0) + name
        self.out.write(head)
        self.out.write(body)
        self.at += len(head) + len(body)

    def close(self) -> tuple[str, int]:
        listing = b"".join(self.directory)
        n = len(self.directory)
        self.out.write(listing + struct.pack(_END, b"PK\5\6", 0, 0, n, n, len(listing), self.at, 0))
        self.out.close()
        return self.name, self.at + len(listing) + struct.calcsize(_END)


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (key, n_bytes, payload) to archives; a member is named key_number_bytes. Files of attempts that don't commit are not in the manifest."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        done, archive, n = [], None, 0
        for batch in iterator:
            for key, length, payload in zip(batch.column("key"), batch.column("n_bytes").to_pylist(), batch.column("payload"), strict=True):
                if archive is None or archive.at >= ARCHIVE_BYTES or len(archive.directory) >= ARCHIVE_MEMBERS:
                    if archive:
                        done.append(archive.close())
                    archive = _Archive(fs, folder)
                key = key.as_py()
                archive.add(f"{'' if key is None else key}_{n}_{length}.wav", wave(payload.as_py()))
                n += 1
        if archive:
            done.append(archive.close())
        return Committed(done)

    def commit(self, messages: list) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        earlier = manifests(fs, folder) if self.overwrite else []
        old = [name for m in earlier for name, _ in listed(fs, m)]
        name = f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())
        fs.move(f"{name}.part", name)  # whole or not at all
        for path in [*earlier, *(f"{folder}/{x}" for x in old)]:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, folder = store(self.path)
        for name in [a for m in messages if m for a, _ in m.archives]:
            fs.delete_file(f"{folder}/{name}")


def manifests(fs: pafs.FileSystem, folder: str) -> list[str]:
    """The manifests of the jobs that have committed to a folder."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def listed(fs: pafs.FileSystem, manifest: str) -> list[tuple[str, int]]:
    with fs.open_input_stream(manifest) as f:
        return [tuple(x) for x in json.loads(f.read())]


@dataclass(frozen=True)
class Span:
    """Bytes of one archive."""

    archive: str
    size: int
    start: int
    end: int


@dataclass
class ByteRange(InputPartition):
    """Bytes of the archives, one after the other: of one, or of neighbours."""

    spans: tuple[Span, ...]

    @property
    def archive(self) -> str:
        return self.spans[0].archive


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    packed: int
    size: int
    crc: int


def directory(file, size: int) -> list[Member]:
    """The members of an archive, from its own directory."""
    end = struct.unpack(_END, file.read_at(struct.calcsize(_END), size - struct.calcsize(_END)))
    if end[0] != b"PK\5\6":
        raise ValueError("no archive of this format")
    raw, at, out = file.read_at(end[5], end[6]), 0, []
    fixed = struct.calcsize(_CENTRAL)
    while at < len(raw):
        x = struct.unpack(_CENTRAL, raw[at : at + fixed])
        out.append(Member(raw[at + fixed : at + fixed + x[10]].decode(), x[16], x[8], x[9], x[7]))
        at += fixed + x[10] + x[11] + x[12]
    return out


def unpack(raw: bytes, member: Member) -> bytes:
    """The member whose local entry begins ``raw``; raises if it isn't whole."""
    if raw[:4] != b"PK\3\4":
        raise ValueError(f"no member at {member.offset}")
    names, extra = struct.unpack("<HH", raw[26:30])
    body = 30 + names + extra
    media = zlib.decompress(raw[body : body + member.packed], -15, member.size or 1)
    if len(media) != member.size or zlib.crc32(media) != member.crc:
        raise ValueError(f"member at {member.offset} is damaged")
    return media


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.strict = str(options.get("onError", "fail")).lower() == "fail"

    def archives(self) -> list[tuple[str, int]]:
        """What the manifests list; all archives of a folder without any."""
        fs, folder = store(self.path)
        if found := manifests(fs, folder):
            return [x for m in found for x in listed(fs, m)]
        return sorted((x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        archives = self.archives()
        size = max(self.range_bytes, -(-sum(n for _, n in archives) // MOST_RANGES))
        out, held, room = [], [], size
        for name, n in archives:
            at = 0
            while at < n:
                take = min(room, n - at)
                held.append(Span(name, n, at, at + take))
                at, room = at + take, room - take
                if not room:
                    out.append(ByteRange(tuple(held)))
                    held, room = [], size
        return [*out, ByteRange(tuple(held))] if held or not out else out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, folder = store(self.path)
        for span in partition.spans:
            yield from self._span(fs, f"{folder}/{span.archive}", span)

    def _span(self, fs, where: str, partition: Span) -> Iterator[pa.RecordBatch]:
        file = fs.open_input_file(where)
        members = [m for m in directory(file, partition.size) if partition.start <= m.offset < partition.end]
        at = 0
        while at < len(members):
            to, size = at + 1, members[at].size
            while to < len(members) and size + members[to].size <= BATCH_BYTES:
                size += members[to].size
                to += 1
            group = members[at:to]
            first = group[0].offset
            last = members[to].offset if to < len(members) else group[-1].offset + 30 + 65536 + group[-1].packed
            try:
                chunk = memoryview(file.read_at(min(last, partition.size) - first, first))
            except OSError:
                chunk = memoryview(b"")
            media = [self._member(fs, where, m, chunk[m.offset - first :]) for m in group]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(k) if (k := m.name.split("_")[0]) else None for m in group], pa.int64()),
                    pa.array([m.name for m in group]),
                    pa.array([int(m.name.split("_")[2].split(".")[0]) for m in group], pa.int64()),
                    pa.array([m.offset for m in group], pa.int64()),
                    pa.array([x[0] for x in media], pa.binary()),
                    pa.array([x[1] for x in media], pa.string()),
                ],
                names=["key", "member", "n_bytes", "offset", "media", "error"],
            )
            at = to

    def _member(self, fs, where: str, member: Member, raw: bytes) -> tuple[bytes | None, str | None]:
        for again in range(TRIES):
            try:
                if again:
                    time.sleep(WAIT_S * again)
                    with fs.open_input_file(where) as f:
                        raw = f.read_at(30 + 65536 + member.packed, member.offset)
                return unpack(raw, member), None
            except (OSError, ValueError, zlib.error) as e:
                error = f"{where} at {member.offset}: {e}"
        if self.strict:
            raise OSError(error)
        return None, error


class ArchiveSource(DataSource):
    """Options: path; rangeBytes; onError (``fail``, or ``report`` for a null media with an error)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key long, member string, n_bytes long, offset long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool):
        return ArchiveWriter(self.options["path"], overwrite)


def payloads(docs: DataFrame) -> DataFrame:
    """(key, n_bytes, payload): the UTF-8 bytes of ``text``, then zero bytes up to a positive multiple of 64."""

    def run(batches):
        for part in tb.slices(batches):
            data, off = tb.column_bytes(part.column("text"))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(off)), pa.array([padded(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["key", "n_bytes", "payload"])

    return docs.selectExpr("cast(doc_id as long) key", "cast(text as string) text").mapInArrow(run, "key long, n_bytes long, payload binary")


def write_archives(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (key long, n_bytes long, payload binary) into archives below ``path``, beside those of earlier jobs or instead of them."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    rows.select("key", "n_bytes", "payload").write.format(NAME).mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, on_error: str = "fail") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("rangeBytes", range_bytes).option("onError", on_error).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Digests and signal features of what was read: samples, their sum, energy about the middle level, and crossings of it."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column("media"):
                raw = raw.as_py()
                body = samples_of(raw)
                level = np.frombuffer(body, np.uint8).astype(np.int64) - 128
                up = level >= 0
                feature = f"{len(body)}:{int(level.sum()) + 128 * len(body)}:{int((level * level).sum())}:{int((up[1:] != up[:-1]).sum())}"
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("key", "n_bytes", "media").mapInArrow(run, FEATURES)


def store_and_read_back(docs: DataFrame) -> DataFrame:
    """All texts into archives in the shared folder, read again, with features."""
    spark = tune(docs.sparkSession)
    path = new_path(spark, "media")
    write_archives(payloads(docs), path)
    return features(read_archives(spark, path))
