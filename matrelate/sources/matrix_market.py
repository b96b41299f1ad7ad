"""Matrix Market files.

Lines are parsed by Spark, so a file is read in splits; only the header is read
first.  Reading accepts coordinate files of real, integer, complex and pattern
data and dense ("array") files, checks the number of entries against the size
line, and expands symmetric halves.  Writing gives a folder: the header in a
file of its own, and one file per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.generate import symmetrize_triplets

FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    layout: str = "coordinate"


def parse_header(line: str) -> Header:
    """The banner line."""
    words = line.split()
    if len(words) != 5 or words[0] != "%%MatrixMarket" or words[1] != "matrix":
        raise ValueError(f"not a Matrix Market banner: {line!r}")
    if words[2] not in ("coordinate", "array"):
        raise ValueError(f"unknown layout: {line!r}")
    if words[3] not in FIELDS or words[4] not in SYMMETRIES or (words[2], words[3]) == ("array", "pattern"):
        raise ValueError(f"unknown field or symmetry: {line!r}")
    return Header(words[3], words[4], words[2])


def read(spark: SparkSession, path: str, square: bool = True) -> Matrix:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    if found is None:
        raise ValueError(f"{path} has no banner")
    header = parse_header(found["value"])
    is_data = ~F.col("value").startswith("%") & (F.trim("value") != "")
    # the size line is the first line after the comments in the file that has the banner
    size = spark.read.text(found["file"]).where(is_data).first()["value"].split()
    rows, cols = int(size[0]), int(size[1])
    if square and rows != cols:
        raise ValueError(f"{path} is {rows} x {cols}, not square")
    data = lines.where(is_data).withColumn("p", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    if header.layout == "array":
        return _read_array(data, header, rows, cols, found["file"])
    width = {"real": 3, "integer": 3, "complex": 4, "pattern": 2}[header.field]
    number = lambda k, kind: F.col("p")[k].cast(kind)
    if header.field == "complex":
        values = [number(2, "double").alias("re"), number(3, "double").alias("im")]
    else:
        values = [(F.lit(1.0) if header.field == "pattern" else number(2, "double")).alias("v")]
    mark = F.concat_ws(" ", "p") == " ".join(size)
    # the size line may look like an entry: one row that equals it is none
    counted = data.agg(F.count_if(F.size("p") == width).alias("n"), F.count_if(mark & (F.size("p") == width)).alias("same")).first()
    entries = data.where((F.size("p") == width) & ~mark)
    if counted["same"] > 1:
        entries = entries.unionByName(data.where(mark).limit(counted["same"] - 1))
    count = counted["n"] - (counted["same"] > 0)
    if count != int(size[2]):
        raise ValueError(f"{path} has {count} entries, its size line says {size[2]}")
    entries = entries.select(number(0, "long").alias("i"), number(1, "long").alias("j"), *values)
    return Matrix.from_triplets(symmetrize_triplets(entries, header.symmetry), rows, cols)


def _read_array(data: DataFrame, header: Header, rows: int, cols: int, first_file: str) -> Matrix:
    """Values column by column; of symmetric matrices the lower half only.

    A value's place is its number in the file: lines are counted per block of
    a file, and numbered inside it in the order in which they are read.
    """
    data = data.withColumn("at", F.monotonically_increasing_id())
    blocks = data.groupBy("file", "block").count().orderBy(F.col("file") != first_file, "file", "block").collect()  # one row a block
    total = sum(r["count"] for r in blocks) - 1
    half = header.symmetry != "general"
    skew = int(header.symmetry == "skew-symmetric")
    expected = rows * cols if not half else rows * (rows + 1 - 2 * skew) // 2
    if total != expected:
        raise ValueError(f"the file has {total} values instead of {expected}")
    starts, at = [], -1  # the size line is number -1
    for r in blocks:
        starts.append((r["file"], r["block"], at))
        at += r["count"]
    spark = data.sparkSession
    before = F.broadcast(spark.createDataFrame(starts, "file string, block long, before long"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = data.withColumn("inside", inside).join(before, ["file", "block"]).withColumn("t", F.col("before") + F.col("inside")).where("t >= 0")
    if half:
        # column j of a half holds side - j values
        side = rows - skew
        start = lambda j: j * side - F.floor(j * (j - 1) / 2)
        guess = F.floor((2 * side + 1 - F.sqrt(F.lit(float((2 * side + 1) ** 2)) - 8.0 * F.col("t"))) / 2).cast("long")
        column = F.when(start(guess) > F.col("t"), guess - 1).when(start(guess + 1) <= F.col("t"), guess + 1).otherwise(guess)
        numbered = numbered.withColumn("c", column).withColumn("r", F.col("t") - start(F.col("c")) + F.col("c") + skew)
    else:
        numbered = numbered.withColumn("c", F.floor(F.col("t") / rows)).withColumn("r", F.col("t") % rows)
    value = lambda k: F.col("p")[k].cast("double")
    values = [value(0).alias("re"), value(1).alias("im")] if header.field == "complex" else [value(0).alias("v")]
    entries = numbered.select((F.col("r") + 1).cast("long").alias("i"), (F.col("c") + 1).cast("long").alias("j"), *values)
    keep = " or ".join(f"{v} <> 0" for v in (("re", "im") if header.field == "complex" else ("v",)))
    return Matrix.from_triplets(symmetrize_triplets(entries.where(keep), header.symmetry), rows, cols)


def size_line(m: Matrix, layout: str = "coordinate") -> str:
    return f"{m.rows} {m.cols}" if layout == "array" else f"{m.rows} {m.cols} {m.df.count()}"


def lines(m: Matrix) -> DataFrame:
    """One text line per stored entry."""
    number = lambda c: F.col(c).cast("string")
    return m.df.select(F.concat_ws(" ", number("i"), number("j"), *[number(c) for c in m.values]).alias("value"))


def array_lines(m: Matrix) -> DataFrame:
    """One text line per place of the matrix, stored or not, column by column."""
    places = m.spark.range(m.rows * m.cols).select((F.col("id") % m.rows + 1).alias("i"), (F.floor(F.col("id") / m.rows) + 1).cast("long").alias("j"))
    full = places.join(m.df, ["i", "j"], "left")
    value = F.concat_ws(" ", *[F.coalesce(c, F.lit(0.0)).cast("string") for c in m.values])
    return full.orderBy("j", "i").select(value.alias("value"))


def banner(m: Matrix, layout: str = "coordinate") -> str:
    return f"%%MatrixMarket matrix {layout} {'complex' if m.is_complex else 'real'} general"


def write(m: Matrix, path: str, layout: str = "coordinate") -> None:
    """A folder: a file with the header, and the parts, whose names sort in the order of an array's values."""
    spark = m.spark
    head = spark.createDataFrame([(f"{banner(m, layout)}\n%\n{size_line(m, layout)}",)], "value string").coalesce(1)
    (array_lines(m) if layout == "array" else lines(m)).write.text(path)
    head.write.mode("append").text(path)


def print_matrix(m: Matrix) -> str:
    """The whole text of a small matrix, sorted by column and row."""
    body = [r["value"] for r in lines(m.with_df(m.df.orderBy("j", "i"))).collect()]
    return "\n".join([banner(m), "%", size_line(m), *body]) + "\n"
