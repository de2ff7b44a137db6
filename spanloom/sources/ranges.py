"""FASTA as a data source of Spark's own: byte ranges of files in many tasks, a stream of growing files, a sink with a commit.

``register(spark)`` names it "fasta". Folders, files, s3, hdfs and gs addresses are taken through pyarrow's file systems.

* Batch: a record belongs to the range that its ">" stands in, so a file is read by as many tasks as it has ranges of
  ``splitBytes``. A compressed file (.gz) can't be split and is one range. Rows: path, place of the ">" in the file, header, seq.
* Stream: the offset is a number of bytes for each file. A growing file is read up to its last record that has ended,
  by the next header or by a blank line, and each record is read once. A compressed file must arrive whole.
* Sink: each task writes a file of its own under a name that no other attempt has; the commit shows those of the tasks that
  succeeded, named in the order of partitions. With ``single`` they are appended to one file, piece by piece.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, start bigint, header string, seq string"
CHUNK = 4 << 20
WHOLE = 1 << 62


def _opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (files.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder whose names begin with neither "_" nor "."; by name."""
    fs, p = _opened(path)
    info = fs.get_file_info(p)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == files.FileType.File else fs.get_file_info(files.FileSelector(p))
    return sorted((path if x is info else f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == files.FileType.File and x.base_name[0] not in "_.")


def cut(f, start: int, end: int, until: int) -> Iterator[tuple[int, bytes]]:
    """(place of ">", record without it) of the records that begin in [start, end) of a file of ``until`` bytes.

    Only blank lines may stand before the first record of a file. No more than a record and a chunk are held.
    """
    at = max(start - 1, 0)
    if at:
        f.seek(at)
    buf = b"" if start else b"\n"
    base, first, parts = at - len(buf), None, []
    while True:
        chunk = f.read(min(CHUNK, until - at))
        at += len(chunk)
        buf += chunk
        i = 0
        while (j := buf.find(b"\n>", i)) >= 0:
            if first is not None:
                yield first, b"".join([*parts, buf[i:j]])
                parts = []
            elif not start and buf[i:j].strip():
                raise ValueError("a sequence without a header")
            first = base + j + 1
            if first >= end:
                return
            i = j + 2
        k = len(buf) if not chunk else max(i, len(buf) - 1)
        if first is not None:
            parts.append(buf[i:k])
        elif not start and buf[i:k].strip():
            raise ValueError("a sequence without a header")
        if not chunk:
            if first is not None:
                yield first, b"".join(parts)
            return
        buf, base = buf[k:], base + k


def record(raw: bytes) -> tuple[str, str]:
    """(header, sequence); a blank line ends a record, so letters after one are an error."""
    head, _, body = raw.partition(b"\n")
    if re.search(rb"\n[ \t\r]*\n", b"\n" + body.rstrip()):
        raise ValueError("a sequence without a header")
    return head.decode().strip(), b"".join(body.split()).decode()


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    until: int


def ranges(path: str, start: int, until: int, split: int) -> list[Range]:
    if path.endswith(".gz"):
        return [Range(path, 0, WHOLE, WHOLE)]
    return [Range(path, a, min(a + split, until), until) for a in range(start, until, split)]


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    """Records of a range in Arrow batches of about a chunk."""
    fs, p = _opened(r.path)
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        cols = [pa.array([r.path] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["path", "start", "header", "seq"])

    with fs.open_input_stream(p, compression="gzip") if r.path.endswith(".gz") else fs.open_input_file(p) as f:
        for at, raw in cut(f, r.start, r.end, r.until):
            rows.append((at, *record(raw)))
            held += len(raw)
            if held >= CHUNK:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def ended(path: str, start: int, size: int) -> int:
    """The end of the last record in [start, size) of a file that is complete; ``start`` if there is none.

    Looked for from the file's end in chunks, so no more than its last record is read.
    """
    fs, p = _opened(path)
    with fs.open_input_file(p) as f:
        buf, at = b"", size
        while at > start:
            n = min(CHUNK, at - start)
            at -= n
            f.seek(at)
            buf = f.read(n) + buf
            head = b"\n" + buf if at == start else buf
            j = head.rfind(b"\n>")
            if j < 0:
                continue
            if re.search(rb"\n[ \t\r]*\n", head[j:]):
                return size
            return at + j + 1 - (len(head) - len(buf))
    return start


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return [r for path, size in _listed(self.path) for r in ranges(path, 0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.seen = path, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of each file up to its last complete record; a file that didn't grow isn't opened."""
        for path, size in _listed(self.path):
            done, was = self.seen.get(path, (0, -1))
            if size != was:
                self.seen[path] = (size if path.endswith(".gz") else ended(path, done, size), size)
        return {path: done for path, (done, _) in self.seen.items() if done}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, until in end.items():
            done = start.get(path, 0)
            if until < done or (path.endswith(".gz") and 0 < done < until):
                raise ValueError(f"{path} was changed after it was read")
            if until > done:
                out += ranges(path, done, until, self.split)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        return


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str


class Writer(DataSourceArrowWriter):
    """Records of rows (header, seq). What failed attempts wrote stays in a hidden folder, which goes by the commit."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, single: bool) -> None:
        if not {"header", "seq"} <= set(schema.names):
            raise ValueError("a FASTA file needs the columns header and seq")
        self.path, self.overwrite, self.single = path.rstrip("/"), overwrite, single
        folder, _, name = self.path.rpartition("/")
        self.hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        fs, p = _opened(self.hidden)
        fs.create_dir(p)
        out = f"{p}/{n:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(out) as f:
            for b in iterator:
                for header, seq in zip(b.column("header").to_pylist(), b.column("seq").to_pylist(), strict=True):
                    if header is None or seq is None or "\n" in header:
                        raise ValueError("a header or a sequence is null, or a header has a line end")
                    f.write(f">{header}\n{seq}\n\n".encode())
        return Written(n, out)

    def commit(self, messages: list[Written | None]) -> None:
        fs, p = _opened(self.path)
        there = fs.get_file_info(p).type
        if there != files.FileType.NotFound and not self.overwrite:
            raise FileExistsError(self.path)
        parts = [m.path for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition)]
        hidden = _opened(self.hidden)[1]
        fs.create_dir(hidden)
        new = f"{hidden}/whole"
        if self.single:
            with fs.open_output_stream(new) as f:
                for x in parts:
                    with fs.open_input_stream(x) as g:
                        while piece := g.read(CHUNK):
                            f.write(piece)
        else:
            fs.create_dir(new)
            for i, x in enumerate(parts):
                fs.move(x, f"{new}/part-{i:06d}.fasta")
        if there == files.FileType.Directory:
            fs.delete_dir(p)
        elif there == files.FileType.File:
            fs.delete_file(p)
        fs.move(new, p)
        fs.delete_dir(hidden)

    def abort(self, messages: list[Written | None]) -> None:
        fs, p = _opened(self.hidden)
        if fs.get_file_info(p).type != files.FileType.NotFound:
            fs.delete_dir(p)


class Fasta(DataSource):
    """Options: path; splitBytes (64 MB), the bytes of a range; single (false), one file instead of a folder."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return int(self.options.get("splitBytes", 64 << 20))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._split())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], self._split())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, self.options.get("single", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fasta)
