"""Shared plumbing: scratch tables, Arrow columns, packed arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-only lower-casing of UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster.  Where it is unset, in
    local mode, a temporary folder is made once and kept in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("matrelate.scratch", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="matrelate-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("matrelate.scratch", root)
    return root


#: Tables made inside ``passing`` blocks that are under way, innermost last.
_made: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, level: int = -1) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if len(_made) >= -level:
        _made[level].append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables materialised inside are deleted at the end, but for those made with ``keep``."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What Arrow batches hold at most, so that workers' memory does not follow the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: Functions that empty what a module remembers between tasks, by module.
caches: dict[str, Callable[[], None]] = {}
_owner = ""


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches; a worker keeps the caches of one operator at a time."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    owner = run.__module__

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        yield from run(batches)
        give_back()

    return df.mapInArrow(guarded, schema)


def claim(owner: str) -> None:
    """Empty the caches of other operators that this worker has run before."""
    global _owner
    if owner != _owner:
        for module, clear in caches.items():
            if module != owner:
                clear()
        _owner = owner
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which a worker that lives on would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, keep: bool = False, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors: every later stage
    reads files that all executors see, so the job's shuffle files can go as
    soon as it has ended.  ``keep`` leaves the table to the ``passing`` block
    outside; ``path`` to the caller.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name, -2 if keep else -1)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a new plan, since a plan takes the setting when it is made
        df.select("*").write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def unbroadcast(spark: SparkSession):
    """Jobs run inside broadcast what ``small`` has counted and nothing else, whatever the session's thresholds.

    Spark goes by the size of compressed files, and the hash tables are built on the driver.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Keys that are broadcast at most (a hash table of about 50 bytes a key if that is one long); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def small(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """A table of keys, marked for broadcast if a count shows that it is small enough, and else for none."""
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids.hint("merge")


#: Keys of rows (an id and a digest, about 200 bytes each) that are broadcast at most.
BROADCAST_KEYS = 200_000


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose columns ``on``, nulls being equal, are a row of ``gone``."""
    other = gone.select(*[F.col(c).alias(f"gone_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"gone_{c}"))
    return rows.join(small(other, BROADCAST_KEYS), same, "left_anti")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None where null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Arrays of at most this many bytes are packed as they are; behind a first byte that says so.
SHORT = 48


def pack(array: np.ndarray) -> bytes:
    """Compress an integer array byte plane by byte plane."""
    array = np.ascontiguousarray(array)
    if array.nbytes <= SHORT:
        return b"\0" + array.tobytes()
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    if blob[0] == 0:
        return np.frombuffer(blob, dtype, offset=1)
    item = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(item, -1).T).view(dtype).ravel()


def bundle(*arrays: np.ndarray) -> bytes:
    """Several packed arrays in one blob."""
    parts = [pack(a) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unbundle(blob: bytes, *dtypes) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(dtypes)}I", blob), 4 * len(dtypes), []
    for size, dtype in zip(sizes, dtypes):
        out.append(unpack(blob[at : at + size], dtype))
        at += size
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of byte strings; remembers the first ``bound`` it is asked for."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
