"""Shared helpers: tables in the cluster's shared folder, and token hashing for Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at once.
SLICE_ROWS = 1_000

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one if all of Spark runs on this machine, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spanloom-")
        shared_dir.own = base
    return base.rstrip("/")


#: Rows of one Arrow batch between the JVM and Python; Spark's default of 10,000 whole texts takes much memory on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from now on, unless the session asks for fewer."""
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_spanloom_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _left[:] = [x for x in _left if x[1] != path]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@atexit.register
def _clean() -> None:
    for spark, path in list(_left):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


# Bytes of a text to what they are in a word: lower-cased, and whether they part words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words [^\\x20\\x09-\\x0D]+.
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text.
ALNUM = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1_000_000


_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


# A word is the polynomial of its bytes' values in an odd base, modulo 2^64: differences of prefix sums, moved to its start.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[_LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    have = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


class Words:
    """The words of many texts as 64-bit hashes: those of text i are ``hashes[ends[i - 1]:ends[i]]``, with ``lengths`` in bytes.

    A-Z count as lower-case; null texts are empty.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, prefixes: tuple[int, ...] = ()) -> None:
        n = len(data)
        inside = ~apart[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True  # texts part words, too
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = True, ~inside
        starts = np.flatnonzero(inside & (before[:n] | first[:n]))
        behind = np.r_[~inside[1:], True] if n else inside
        stops = np.flatnonzero(inside & (behind | first[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * _power(_BASE, n), out=sums[1:])
        back = _power(_INVERSE, n)[starts] if n else np.empty(0, dtype=np.uint64)
        self.lengths = stops - starts
        cut = lambda to, length: mix((sums[to] - sums[starts]) * back + length.astype(np.uint64) * _M1)
        self.hashes = cut(stops, self.lengths)
        #: For each length of ``prefixes`` the hashes of the words' first bytes (of the whole word, if it is shorter).
        self.prefixes = [cut(np.minimum(starts + k, stops), np.minimum(self.lengths, k)) for k in prefixes]
        self.ends = np.searchsorted(starts, offsets)

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, z in zip(self.ends[:-1], self.ends[1:], strict=True):
            yield self.hashes[a:z]


def words_of(column: pa.Array, apart: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, Words]]:
    """(first row, Words) of consecutive rows with about CHUNK_BYTES of text together, at least one."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        here = data[offsets[at] : offsets[to]]
        yield at, _long(here, apart, prefixes) if len(here) > CHUNK_BYTES else Words(here, offsets[at : to + 1] - offsets[at], apart, prefixes)
        at = to


def _long(data: np.ndarray, apart: np.ndarray, prefixes: tuple[int, ...]) -> Words:
    """One text in pieces that end where words are parted, so that a long one takes no more memory at once."""
    parts, a = [], 0
    while a < len(data):
        z = min(a + CHUNK_BYTES, len(data))
        while z < len(data) and not len(cut := np.flatnonzero(apart[data[a:z]])):
            z = min(z + CHUNK_BYTES, len(data))
        if z < len(data):
            z = a + int(cut[-1]) + 1
        parts.append(Words(data[a:z], np.array([0, z - a]), apart, prefixes))
        a = z
    out = parts[0]
    out.hashes, out.lengths = (np.concatenate([getattr(p, x) for p in parts]) for x in ("hashes", "lengths"))
    out.prefixes = [np.concatenate([p.prefixes[k] for p in parts]) for k in range(len(prefixes))]
    out.ends = np.array([0, len(out.hashes)])
    return out


def texts_of(column: pa.Array, apart: np.ndarray) -> Iterator[np.ndarray]:
    """The words' hashes of each text in turn."""
    for _, words in words_of(column, apart):
        yield from words


def text_words(text: str | None, apart: np.ndarray) -> np.ndarray:
    """The words' hashes of one text."""
    return next(texts_of(pa.array([text or ""]), apart))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = words[:m].copy()
    for i in range(1, n):
        h *= _P
        h += words[i : i + m]
    return mix(h + np.uint64(n))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Keys of rows that go which may be broadcast (16 bytes each); beyond, a shuffle join takes them out.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, goes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows named in goes: (id, row), where row is the hash of the text."""
    goes = written(goes.distinct(), "goes").select(F.col("id").alias("go_id_"), F.col("row").alias("go_row_"))
    if goes.count() <= BROADCAST_ROWS:
        goes = F.broadcast(goes)
    return docs.join(goes, docs[id_col].eqNullSafe(F.col("go_id_")) & (F.xxhash64(docs[text_col]) == F.col("go_row_")), "left_anti")
