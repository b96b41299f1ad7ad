"""Binary triplet files and Parquet.

The binary layout is: int32 rows, int32 columns, int32 complex flag, int64
count, then packed entries (int32 column, int32 row, one or two doubles).
Writing makes a folder of parts, each a complete file of its share.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix

HEADER = struct.Struct("<iiiq")


def entry_type(is_complex: bool) -> np.dtype:
    return np.dtype([("j", "<i4"), ("i", "<i4"), ("re", "<f8"), ("im", "<f8")] if is_complex else [("j", "<i4"), ("i", "<i4"), ("v", "<f8")])


def encode(rows: int, cols: int, is_complex: bool, columns: dict[str, np.ndarray]) -> bytes:
    entries = np.zeros(len(columns["i"]), entry_type(is_complex))
    for name in entries.dtype.names:
        entries[name] = columns[name]
    return HEADER.pack(rows, cols, int(is_complex), len(entries)) + entries.tobytes()


def decode(data: bytes, at: int = 0) -> tuple[int, int, bool, np.ndarray]:
    rows, cols, flag, count = HEADER.unpack_from(data, at)
    return rows, cols, bool(flag), np.frombuffer(data, entry_type(bool(flag)), count, at + HEADER.size)


def decode_all(data: bytes) -> Iterator[np.ndarray]:
    """The entries of each part in a file; a line end stands behind a part."""
    at = 0
    while at + HEADER.size <= len(data):
        _, _, _, entries = decode(data, at)
        yield entries
        at += HEADER.size + entries.nbytes + 1


def parts(m: Matrix):
    """The matrix as binary parts, one row each (column ``data``)."""
    rows, cols, flag, names = m.rows, m.cols, m.is_complex, ["i", "j", *m.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(rows, cols, flag, {n: batch.column(k).to_numpy() for k, n in enumerate(names)})])], names=["data"])

    return m.df.mapInArrow(run, "data binary")


def from_parts(data, rows: int, cols: int, is_complex: bool) -> Matrix:
    names = ["i", "j", "re", "im"] if is_complex else ["i", "j", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for entries in decode_all(blob):
                    yield pa.RecordBatch.from_arrays([pa.array(entries[n].astype("i8" if n in "ij" else "f8")) for n in names], names=names)

    schema = ", ".join(f"{n} {'long' if n in 'ij' else 'double'}" for n in names)
    return Matrix(data.mapInArrow(run, schema), rows, cols, is_complex)


def read(spark: SparkSession, path: str) -> Matrix:
    """A file, or a folder of files."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("content").alias("data"))
    head = files.select(F.substring("data", 1, HEADER.size).alias("d")).first()
    if head is None:
        raise ValueError(f"{path} has no binary matrix")
    rows, cols, flag, _ = HEADER.unpack(bytes(head["d"]))
    return from_parts(files, rows, cols, bool(flag))


def write(m: Matrix, path: str) -> None:
    """A folder of files, written by the tasks that hold the entries.

    The text writer copies the bytes of a string column as they are and puts
    a line end behind each row, that is behind each part.
    """
    empty = m.spark.createDataFrame([(bytearray(encode(m.rows, m.cols, m.is_complex, {n: np.zeros(0) for n in ["i", "j", *m.values]})),)], "data binary")
    parts(m).unionByName(empty).select(F.col("data").cast("string").alias("value")).write.text(path)


def write_file(m: Matrix, path: str) -> None:
    """One local file, for exchange with other programs; the matrix is gathered."""
    data = m.df.orderBy("j", "i").toPandas()
    with open(path, "wb") as f:
        f.write(encode(m.rows, m.cols, m.is_complex, {n: data[n].to_numpy() for n in data}))


def write_parquet(m: Matrix, path: str) -> None:
    """Entries as Parquet, the dimensions in the column's comment."""
    note = {"comment": json.dumps({"rows": m.rows, "cols": m.cols})}
    m.df.withMetadata("i", note).write.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> Matrix:
    df = spark.read.parquet(path)
    shape = json.loads(df.schema["i"].metadata["comment"])
    return Matrix.of(df, shape["rows"], shape["cols"])
