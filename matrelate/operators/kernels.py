"""Blocked dense multiplication for matrices that are well filled.

Entries are cut into square tiles.  Tiles that meet on the inner index are
joined and multiplied with NumPy where they meet; a task adds up what belongs
to one place before anything moves, so the shuffle carries sums of tiles, not
the n^3 / block^3 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from . import algebra, generate

#: Above this share of stored entries in both operands tiles pay off, from this dimension on.
DENSE_FILL, DENSE_SIDE = 0.1, 128
BLOCK = 256
#: Bytes of partial sums that a task holds before it passes them on.
HELD_BYTES = 128 << 20


def _kind(m: Matrix) -> np.dtype:
    return np.dtype(np.complex128 if m.is_complex else np.float64)


def _tiles(m: Matrix, row: str, col: str, name: str, size: int) -> DataFrame:
    """(row tile, column tile, values): a dense tile as bytes, from the entries that fall into it."""
    kind = _kind(m)
    placed = m.df.select(
        F.floor((F.col("i") - 1) / size).cast("long").alias("r"), F.floor((F.col("j") - 1) / size).cast("long").alias("c"),
        ((F.col("i") - 1) % size).cast("int").alias("x"), ((F.col("j") - 1) % size).cast("int").alias("y"), *m.values,
    )
    placed = placed.repartition("r", "c").sortWithinPartitions("r", "c")

    def out(key: tuple[int, int], tile: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([tile.tobytes()])], names=[row, col, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        for batch in batches:
            r, c, x, y, *v = (batch.column(k).to_numpy() for k in range(batch.num_columns))
            cells = v[0] if len(v) == 1 else v[0] + 1j * v[1]
            cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(c) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(r)]):
                if lo == hi:
                    continue
                key = (int(r[lo]), int(c[lo]))
                if key != at:
                    if at is not None:
                        yield out(at, tile)
                    at, tile = key, np.zeros((size, size), kind)
                tile[x[lo:hi], y[lo:hi]] = cells[lo:hi]
        if at is not None:
            yield out(at, tile)

    return placed.mapInArrow(run, f"{row} long, {col} long, {name} binary")


def gemm_blocked(a: Matrix, b: Matrix, alpha: float = 1.0, threshold: float = 0.0, size: int = BLOCK) -> Matrix:
    """alpha * a b by tiles, real or complex."""
    if a.cols != b.rows:
        raise ValueError(f"{a.rows} x {a.cols} times {b.rows} x {b.cols}")
    if a.is_complex or b.is_complex:
        a, b = generate.to_complex(a), generate.to_complex(b)
    kind = _kind(a)
    tile_bytes = kind.itemsize * size * size
    pairs = _tiles(a, "r", "k", "left", size).join(_tiles(b, "k", "c", "right", size), "k").select("r", "c", "left", "right")
    read = lambda cell: np.frombuffer(cell.as_buffer(), kind).reshape(size, size)

    def multiply_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (r, c), tile in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([c]), pa.array([tile.tobytes()])], names=["r", "c", "tile"])
            sums.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                product = read(batch.column(2)[k]) @ read(batch.column(3)[k])
                if key in sums:
                    sums[key] += product
                    continue
                if len(sums) * tile_bytes >= HELD_BYTES:
                    yield from flush()
                sums[key] = product
        yield from flush()

    values = ["re", "im"] if a.is_complex else ["v"]

    def entries(key: tuple[int, int], tile: np.ndarray) -> pa.RecordBatch:
        tile = tile * alpha
        x, y = np.nonzero(np.abs(tile) > threshold)
        found = tile[x, y]
        columns = [found.real, found.imag] if len(values) == 2 else [found]
        return pa.RecordBatch.from_arrays([pa.array(x + key[0] * size + 1), pa.array(y + key[1] * size + 1), *[pa.array(np.ascontiguousarray(v)) for v in columns]], names=["i", "j", *values])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if key != at:
                    if at is not None:
                        yield entries(at, total)
                    at, total = key, np.zeros((size, size), kind)
                total += read(batch.column(2)[k])
        if at is not None:
            yield entries(at, total)

    partial = pairs.mapInArrow(multiply_here, "r long, c long, tile binary")
    summed = partial.repartition("r", "c").sortWithinPartitions("r", "c")
    schema = ", ".join(["i long", "j long", *[f"{v} double" for v in values]])
    return a.with_df(summed.mapInArrow(add_up, schema), rows=a.rows, cols=b.cols)


def multiply(a: Matrix, b: Matrix, alpha: float = 1.0, threshold: float = 0.0) -> Matrix:
    """The kernel that fits: tiles if both operands are filled above ``DENSE_FILL``, else the join.

    Entries are counted once per matrix; small ones are not counted at all.
    """
    if min(a.rows, a.cols, b.cols) >= DENSE_SIDE and min(m.entries() / (m.rows * m.cols) for m in (a, b)) > DENSE_FILL:
        return gemm_blocked(a, b, alpha, threshold)
    return algebra.gemm(a, b, alpha, threshold=threshold)
