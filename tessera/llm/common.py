"""What the operators share: shared-folder tables, sources, Arrow text buffers and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front as far as columns of a table clash (Spark's names know no case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


# --- tables in the shared folder -------------------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it, and then
    uses a folder beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "_checkpoints"
    return root.rstrip("/")


class Shared:
    """Tables written to the shared folder and read again: lineage is cut there, and lost executors lose nothing.

    A table that a returned DataFrame still reads is kept until the driver ends; the others go with drop()."""

    _kept: list[tuple[JavaObject, JavaObject]] = []  # file system and path

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{shared_root(self.spark)}/tessera-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if keep:
            self._kept.append(_place(self.spark, path))
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes the tables, but for so many of the last."""
        at = len(self.paths) - keep
        for path in self.paths[:at]:
            delete(self.spark, path)
        self.paths = self.paths[at:]

    def keep(self) -> None:
        """Leaves the tables until the driver ends."""
        self._kept += [_place(self.spark, path) for path in self.paths]
        self.paths = []

    @classmethod
    def kept(cls) -> int:
        """How many tables are kept until the driver ends."""
        return len(cls._kept)

    @classmethod
    def release(cls, since: int) -> None:
        """Deletes those kept after the first so many: what reads them has been written."""
        for files, at in cls._kept[since:]:
            files.delete(at, True)
        del cls._kept[since:]


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


@atexit.register
def _at_end() -> None:
    """Runs before the driver's JVM ends; where that has gone first, the cluster's cleaning of the folder is left."""
    for files, at in Shared._kept:
        try:
            files.delete(at, True)
        except (Py4JError, OSError):
            return


# --- tasks -----------------------------------------------------------------------------------------------------------


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, free: Callable[[], None]) -> None:
    """Names what the tasks of one kind keep in their worker from task to task, and how to let it go."""
    _held[name] = free


def let_go(but: str = "") -> None:
    for name in [x for x in _held if x != but]:
        _held.pop(name)()


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for a partition. As Spark uses workers again, what tasks of other kinds kept there goes first, and at
    its end freed memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


# --- text buffers ----------------------------------------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def lower_ascii() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def byte_class(keep: bytes | None = None, drop: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: those of `keep`, or all but those of `drop`."""
    lut = np.zeros(256, bool)
    if keep is not None:
        lut[list(keep)] = True
    else:
        lut[:] = True
        lut[list(drop or b"")] = False
    return lut


#: Letters and digits once A-Z are lower-cased, and everything beyond ASCII.
WORD_BYTES = byte_class(keep=b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: All but ASCII white space.
SOLID_BYTES = byte_class(drop=b"\x20\x09\x0a\x0b\x0c\x0d")

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers from 0 on, of which span_hashes asks for STEP_BYTES + 1 at most: 8 MB a base for the worker's life."""
    if which not in _powers:
        out = np.full(STEP_BYTES + 1, base, np.uint64)
        out[0] = 1
        _powers[which] = np.multiply.accumulate(out)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of `data`; spans begin and end in rising order. Linear in len(data), and worked on in
    parts of at most STEP_BYTES, so a long text needs little beside its spans."""
    h = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + STEP_BYTES, "right")))
        if b == a + 1:  # may be longer than a part
            total, step = 0, 1
            for at in range(low, int(ends[a]), STEP_BYTES):
                part = data[at : min(at + STEP_BYTES, int(ends[a]))]
                total += int((_BYTE[part] * _power("r", _R, len(part))).sum(dtype=np.uint64)) * step
                step = step * pow(int(_R), STEP_BYTES, 1 << 64) % (1 << 64)
            h[a] = total % (1 << 64)
        else:
            part = data[low : int(ends[b - 1])]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _power("r", _R, len(part)), out=total[1:])
            h[a:b] = (total[ends[a:b] - low] - total[starts[a:b] - low]) * _power("i", _R_INV, len(part) + 1)[starts[a:b] - low]
        a = b
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the rows, and the index of each row's first word (with the count at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on where k words are left."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _GRAM[0]
    for j in range(1, k):
        h = h + words[j : j + n] * _GRAM[j]
    return mix(h)


# --- packed shuffles -------------------------------------------------------------------------------------------------


def scatter(df: DataFrame, buckets: int) -> DataFrame:
    """Send packed rows (bucket, ...) to the task of their bucket."""
    return df.repartitionById(buckets, F.col("bucket").cast("int"))
