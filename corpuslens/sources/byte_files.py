"""Files of any size as data sources that open each file themselves.

``binaryFile`` puts a whole file into one cell, which cannot hold 2 GiB.  The sources here list
files on the driver, deal them into partitions by their bytes, and read inside the task: digests a
chunk at a time, headers by seeking from chunk to chunk, signals one file at a time.  Whatever the
size of a file, a digest holds ``CHUNK`` bytes of it.

Schemes are those of ``pyarrow.fs`` (local files, S3, GCS, HDFS); :func:`reachable` tells.
"""

from __future__ import annotations

import fnmatch
import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslens.schemas import SIGNAL

CHUNK = 8 << 20
#: Bytes of files in a partition, and what opening a file counts.
PART_BYTES, OPEN_COST = 128 << 20, 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, prefix that makes a path in it a URI again)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    scheme = path.split(":", 1)[0]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return system, inside, path[:len(path) - len(path.split("://", 1)[1])] if scheme != "hdfs" else path[:path.index(inside)]


def reachable(path: str) -> bool:
    """Whether the sources can open files below a path; others are left to Spark's readers."""
    try:
        file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


@dataclass
class Files(InputPartition):
    """Files that one task reads: path in the file system and length."""

    files: tuple[tuple[str, int], ...]


def dealt(files: Sequence[tuple[str, int]], part_bytes: int = PART_BYTES) -> list[Files]:
    """Files in parts of about equal cost; a file larger than a part has one of its own."""
    parts, now, cost = [], [], 0
    for path, length in sorted(files):
        if now and cost + length + OPEN_COST > part_bytes:
            parts.append(Files(tuple(now)))
            now, cost = [], 0
        now.append((path, length))
        cost += length + OPEN_COST
    return parts + [Files(tuple(now))] if now else parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Files]:
        system, inside, _ = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(inside, recursive=True)) if (
            system.get_file_info(inside).type == fs.FileType.Directory) else [system.get_file_info(inside)]
        kept = [(f.path, f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob)
                and not f.base_name.startswith(("_", "."))]
        return dealt(kept, self.part_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, prefix = file_system(self.path)
        for path, length in partition.files:
            yield self.row(system, path, prefix + path, length)

    def row(self, system: fs.FileSystem, path: str, uri: str, length: int) -> tuple:
        raise NotImplementedError


class _Source(DataSource):
    reads: type[_Reader]

    def reader(self, schema) -> DataSourceReader:
        return self.reads(dict(self.options))


class _DigestReader(_Reader):
    def row(self, system, path, uri, length):
        sha256, md5, seen = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
        with system.open_input_stream(path, buffer_size=0) as f:
            while chunk := f.read(CHUNK):
                sha256.update(chunk)
                md5.update(chunk)
                seen += len(chunk)
        if seen != length:
            raise OSError(f"{uri} had {length} bytes when it was listed, {seen} when it was read")
        return uri, uri.rsplit("/", 1)[1], length, sha256.hexdigest(), md5.hexdigest()


class FileDigests(_Source):
    """path, name, length, sha256 and md5 of every file."""

    reads = _DigestReader

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, name string, length long, sha256 string, md5 string"


# --- wave files -------------------------------------------------------------------------------

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Reasons why a file gives no signal.
NOT_WAVE, NO_FORMAT, NO_DATA, TRUNCATED = "not a RIFF wave file", "no fmt chunk before the data", "no data chunk", "the data chunk is truncated"
BAD_RATE, EMPTY, NOT_FINITE = "invalid sample rate", "empty", "non-finite samples"


@dataclass
class Wave:
    """What the chunks before the samples say."""

    form: int
    channels: int
    sample_rate: int
    width: int
    frames: int
    at: int


def find_chunks(f, length: int) -> Wave | str:
    """Walk the chunks of a wave file up to its samples, reading headers only; or the reason that it has none."""
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return NOT_WAVE
    at, form, wide = 12, None, None
    while len(mark := f.read(8)) == 8:
        name, size = mark[:4], struct.unpack("<I", mark[4:])[0]
        at += 8
        if name == b"ds64":
            wide = struct.unpack("<Q", f.read(16)[8:])[0]
        elif name == b"fmt ":
            said = f.read(min(size, 40))
            if len(said) < 16:
                return NO_FORMAT
            form, channels, rate, _, block = struct.unpack("<HHIIH", said[:14])
            if form == EXTENSIBLE and len(said) >= 26:
                form = struct.unpack("<H", said[24:26])[0]
        elif name == b"data":
            if form is None:
                return NO_FORMAT
            size = wide if wide is not None and size == 0xFFFFFFFF else size
            width = block // channels if channels else 0
            if rate <= 0:
                return BAD_RATE
            if width not in {PCM: (1, 2, 3, 4), FLOAT: (4, 8)}.get(form, ()):
                return f"format {form} of {width} bytes a sample is not supported"
            if size > length - at:
                return TRUNCATED
            return Wave(form, channels, rate, width, size // block, at) if size >= block else EMPTY
        at += size + size % 2
        f.seek(at)
    return NO_DATA


class _HeaderReader(_Reader):
    def row(self, system, path, uri, length):
        with system.open_input_file(path) as f:
            wave = find_chunks(f, length)
        if isinstance(wave, str):
            return uri, length, None, None, None, None, None, wave
        form = "float" if wave.form == FLOAT else "pcm"
        return uri, length, form, wave.channels, wave.sample_rate, 8 * wave.width, wave.frames, None


class WaveHeaders(_Source):
    """Form, channels, rate, bits and frames of every wave file, or the reason that it has none."""

    reads = _HeaderReader

    @classmethod
    def name(cls) -> str:
        return "wave_headers"

    def schema(self) -> str:
        return ("path string, length long, form string, channels int, sample_rate long, bits int, frames long, "
                "reject_reason string")


def decoded(raw: bytes, wave: Wave) -> np.ndarray:
    """Frames x channels, whole-number samples scaled to [-1, 1)."""
    if wave.form == FLOAT:
        x = np.frombuffer(raw, "<f4" if wave.width == 4 else "<f8").astype(np.float64)
    elif wave.width == 1:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128.0
    elif wave.width == 3:
        # Three bytes become the upper ones of four.
        four = np.zeros((len(raw) // 3, 4), np.uint8)
        four[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = four.reshape(-1).view("<i4") / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{wave.width}") / 2.0 ** (8 * wave.width - 1)
    return x.reshape(-1, wave.channels)


class _SignalReader(_Reader):
    def row(self, system, path, uri, length):
        with system.open_input_file(path) as f:
            wave = find_chunks(f, length)
            if isinstance(wave, str):
                return uri, 0, 0, 0, [], wave
            f.seek(wave.at)
            raw = f.read(wave.frames * wave.channels * wave.width)
        x = decoded(raw, wave)
        if not np.isfinite(x).all():
            return uri, wave.sample_rate, wave.channels, 0, [], NOT_FINITE
        return uri, wave.sample_rate, wave.channels, len(x), x.tolist(), None


class WaveSignals(_Source):
    """Decoded samples of every wave file, frames x channels, or the reason that it has none."""

    reads = _SignalReader

    @classmethod
    def name(cls) -> str:
        return "wave_signals"

    def schema(self):
        return SIGNAL


def load(spark: SparkSession, source: type[_Source], path: str, glob: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """Read every matching file below ``path`` by one of the sources here."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("glob", glob).option("partbytes", part_bytes).load()


# --- writing wave files -----------------------------------------------------------------------

def wave_bytes(samples: np.ndarray, sample_rate: int, bits: int, comment: bytes = b"") -> bytes:
    """A wave file of frames x channels; ``comment`` goes into a LIST chunk before the samples.  -32 bits are floats."""
    x, floats, bits = np.atleast_2d(np.asarray(samples, np.float64)), bits < 0, abs(bits)
    top = 2.0 ** (bits - 1)
    if floats:
        raw = x.astype("<f4").tobytes()
    else:
        whole = np.clip(np.floor(x * top), -top, top - 1).astype("<i4").reshape(-1)
        raw = (whole + 128).astype(np.uint8).tobytes() if bits == 8 else whole.view(np.uint8).reshape(-1, 4)[:, :bits // 8].tobytes()
    block = x.shape[1] * bits // 8
    chunks = [(b"fmt ", struct.pack("<HHIIHH", FLOAT if floats else PCM, x.shape[1], sample_rate, sample_rate * block, block, bits))]
    chunks += [(b"LIST", comment)] if comment else []
    body = b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in [*chunks, (b"data", raw)])
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def _write(batches: Iterator, path: str) -> Iterator:
    system, inside, prefix = file_system(path)
    for batch in batches:
        written = []
        for row in batch.itertuples(index=False):
            data = wave_bytes(np.stack(row.samples) if len(row.samples) else np.zeros((0, 1)), row.sample_rate, row.bits,
                              row.comment.encode() if row.comment else b"")
            # A task that runs twice writes the same bytes under the same name.
            with system.open_output_stream(f"{inside}/{row.name}.partial-{hashlib.md5(data).hexdigest()}") as f:
                f.write(data)
            system.move(f"{inside}/{row.name}.partial-{hashlib.md5(data).hexdigest()}", f"{inside}/{row.name}")
            written.append((row.name, f"{prefix}{inside}/{row.name}", len(data)))
        yield type(batch)(written, columns=["name", "path", "length"])


def write_waves(signals: DataFrame, path: str) -> DataFrame:
    """name, path and length of a wave file for each row: name, sample_rate, bits (8, 16, 24, 32, or -32 for
    floats), comment (may be null) and samples, frames x channels.  Written when the result is read."""
    file_system(path)[0].create_dir(file_system(path)[1], recursive=True)
    return signals.select("name", "sample_rate", "bits", "comment", "samples").mapInPandas(
        lambda batches: _write(batches, path), "name string, path string, length long")
