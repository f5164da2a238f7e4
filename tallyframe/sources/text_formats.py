"""Text formats: MatrixMarket files, 10x folders, wide CSV tables, DGE files.

Everything is read by Spark's own readers (gzip by suffix); line numbers come
from the order of lines within files that Spark reads as one sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import running
from ..matrix import CountMatrix
from .errors import LayoutError, MatrixParseError
from .names import convert_counts

FIELDS = {"real": "double", "integer": "long"}


@dataclass(frozen=True)
class Header:
    kind: str
    rows: int
    columns: int
    entries: int


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_banner(line: str) -> str:
    """The value type named by the first line, ``coordinate real|integer general`` matrices only."""
    words = line.split()
    if len(words) != 5 or words[0] != "%%MatrixMarket":
        raise MatrixParseError(f"not a MatrixMarket header: {line}")
    what, form, field, symmetry = (w.lower() for w in words[1:])
    for got, known in ((what, ("matrix",)), (form, ("coordinate",)), (field, tuple(FIELDS)), (symmetry, ("general",))):
        if got not in known:
            raise MatrixParseError(f"unsupported {got!r} in the header; known: {', '.join(known)}")
    return FIELDS[field]


def read_header(spark: SparkSession, path: str) -> Header:
    """Banner and size line; comment and blank lines between them are skipped."""
    lines = spark.read.text(path)
    banner = lines.first()
    if banner is None:
        raise MatrixParseError(f"empty file: {path}")
    kind = check_banner(banner.value)
    size = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    words = size.value.split() if size else []
    if len(words) != 3 or not all(w.isdigit() for w in words):
        raise MatrixParseError(f"no size line in {path}")
    return Header(kind, *map(int, words))


def read_mm(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """Header and (row, column, value), 1-based, repeated coordinates summed.

    The number of entries must be what the size line says.
    """
    head = read_header(spark, path)
    body = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    size = F.array(*(F.lit(str(x)) for x in (head.rows, head.columns, head.entries)))
    # The size line has three whole numbers too; it is one row that looks like an entry and is taken off below.
    word = lambda i, kind: F.get("w", F.lit(i)).try_cast(kind)
    rows = body.select(word(0, "long").alias("row"), word(1, "long").alias("column"), word(2, head.kind).alias("value"), (F.col("w") == size).alias("is_size"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if(F.col("row").isNull() | F.col("column").isNull() | F.col("value").isNull()).alias("bad"), F.count_if("is_size").alias("sizes"), F.count_if(~F.col("is_size") & ((F.col("row") < 1) | (F.col("row") > head.rows) | (F.col("column") < 1) | (F.col("column") > head.columns))).alias("outside")).first()
    if counted.bad or counted.outside or counted.n - 1 != head.entries:
        raise MatrixParseError(f"{path}: {counted.n - 1} entries ({counted.bad} unreadable, {counted.outside} outside), {head.entries} announced")
    # If an entry happens to read like the size line, only one of them is taken off.
    extra = counted.sizes - 1
    own = rows.filter(~F.col("is_size")).select("row", "column", "value")
    if extra:
        again = spark.createDataFrame([(head.rows, head.columns, head.entries)] * extra, "row long, column long, value long")
        own = own.unionByName(again.withColumn("value", F.col("value").cast(head.kind)))
    return head, own.groupBy("row", "column").agg(F.sum("value").alias("value"))


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the lines of one file with 1-based numbers in file order; a path of several files raises an error."""
    place, lines = F.monotonically_increasing_id(), spark.read.text(path)
    # Spark reads several files in an order of its own.
    if len(files := lines.inputFiles()) > 1:
        raise ValueError(f"{path}: lines of {len(files)} files have no order")
    rows = lines.select("value", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # One number a task, never one a line.
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") + 1).alias("id"), "value")


def names_file(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(id, name) from a tab-separated column (1-based); a line with fewer columns gives its last."""
    words = F.split("value", "\t")
    return line_numbers(spark, path).select("id", F.element_at(words, F.least(F.lit(column), F.size(words))).alias("name"))


def assemble(entries: DataFrame, features: DataFrame, barcodes: DataFrame, unique_features: bool) -> CountMatrix:
    """A matrix from features x cells entries and (id, name) tables."""
    coo = entries.select(F.col("column").alias("cell_id"), F.col("row").alias("feature_id"), "value")
    return convert_counts(coo, barcodes.withColumnRenamed("id", "cell_id"), features.withColumnRenamed("id", "feature_id"), unique_features)


def read_trio(spark: SparkSession, matrix: str, features: str, barcodes: str, gene_column: int, unique_features: bool) -> CountMatrix:
    for path in (matrix, features, barcodes):
        if not exists(spark, path):
            raise LayoutError(f"missing {path}")
    head, entries = read_mm(spark, matrix)
    f, b = names_file(spark, features, gene_column), names_file(spark, barcodes, 1)
    if f.count() != head.rows or b.count() != head.columns:
        raise LayoutError(f"names do not fit a {head.rows} x {head.columns} matrix")
    return assemble(entries, f, b, unique_features)


def read_10x(spark: SparkSession, folder: str, gene_column: int = 2, unique_features: bool = True) -> CountMatrix:
    """A 10x folder; the third version's file names when ``features.tsv.gz`` exists."""
    names = ("matrix.mtx.gz", "features.tsv.gz", "barcodes.tsv.gz") if exists(spark, f"{folder}/features.tsv.gz") else ("matrix.mtx", "genes.tsv", "barcodes.tsv")
    return read_trio(spark, *(f"{folder}/{n}" for n in names), gene_column, unique_features)


def read_geo(spark: SparkSession, prefix: str, gene_column: int = 2, unique_features: bool = True) -> CountMatrix:
    """The same three files by a common prefix, all gzipped if the matrix is."""
    end = ".gz" if exists(spark, f"{prefix}matrix.mtx.gz") else ""
    return read_trio(spark, *(f"{prefix}{n}{end}" for n in ("matrix.mtx", "genes.tsv", "barcodes.tsv")), gene_column, unique_features)


def read_csv(spark: SparkSession, path: str, unique_features: bool = True, sep: str = ",") -> CountMatrix:
    """A dense table, features in rows, the first column their names, the header the cells; zeros are dropped."""
    header = line_numbers(spark, path).filter("id = 1").first()
    if header is None:
        raise LayoutError(f"empty file: {path}")
    cells = [c.strip().strip('"') for c in header.value.split(sep)][1:]
    split = F.split("value", sep)
    lines = line_numbers(spark, path).filter("id > 1 and trim(value) <> ''").select((F.col("id") - 1).alias("feature_id"), split.alias("w"))
    features = lines.select("feature_id", F.trim(F.regexp_replace(F.col("w")[0], '"', "")).alias("name"))
    values = lines.select("feature_id", F.posexplode(F.slice("w", 2, len(cells))).alias("at", "v")).select((F.col("at") + 1).cast("long").alias("cell_id"), "feature_id", F.col("v").cast("double").alias("value")).filter("value <> 0")
    names = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], "cell_id long, name string")
    return convert_counts(values, names, features, unique_features)


def read_dge(spark: SparkSession, path: str, unique_features: bool = True) -> CountMatrix:
    """A MatrixMarket file whose comments name genes and cells (tab-separated)."""
    _, entries = read_mm(spark, path)
    comments = line_numbers(spark, path).filter(F.col("value").startswith("%%"))

    def names(tag: str) -> DataFrame:
        lists = comments.filter(F.col("value").startswith(tag)).select("id", F.slice(F.split("value", "\t"), 2, 2**30).alias("names"))
        placed = running(lists, "id", F.size("names")).select((F.col("upto") - F.size("names")).alias("before"), F.posexplode("names").alias("at", "name"))
        return placed.select((F.col("before") + F.col("at") + 1).alias("id"), "name")

    return assemble(entries, names("%%GENES"), names("%%CELL_BARCODES"), unique_features)


def write_mm(m: CountMatrix, folder: str) -> None:
    """The matrix as text parts (features x cells triplets) with name tables, readable by Spark."""
    m.coo.select(F.concat_ws(" ", "feature_id", "cell_id", "value")).write.text(f"{folder}/entries")
    m.features.write.option("sep", "\t").csv(f"{folder}/features")
    m.cells.write.option("sep", "\t").csv(f"{folder}/cells")
