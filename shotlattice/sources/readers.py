"""Inputs: JSON artifacts, JSON lines, whitespace lines, blocks of text, tables with embedded JSON, and model output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions.chance import uniform

c = F.col


def artifact(spark: SparkSession, path: str, schema: StructType | str, made_by: str) -> DataFrame:
    """One JSON document per file with a fixed schema; a missing file names the stage that makes it."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: run {made_by} first") from e


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The words of every line that has some, with the file."""
    return line_words(spark.read.text(path).select(F.input_file_name().alias("file"), "value"), "value")


def line_words(rows: DataFrame, line: str) -> DataFrame:
    """Rows with a line's ``words`` in its place; lines without any are left out."""
    return rows.withColumn("words", F.array_remove(F.split(line, r"\s+"), "")).drop(line).where("size(words) > 0")


def strided_csv(rows: DataFrame, file: str, order: str, line: str, every: int) -> DataFrame:
    """(file, name, box, inside) of every ``every``-th line "name,x1,y1,x2,y2,gaze" of a file, from the first; a gaze below 0 is outside."""
    at = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    parts = rows.where(F.trim(line) != "").withColumn("at_", at).where(F.pmod("at_", F.lit(every)) == 0).withColumn("p", F.split(line, ","))
    box = F.transform(F.slice("p", 2, 4), lambda x: F.rint(x.cast("double")).cast("int"))
    return parts.select(file, F.trim(c("p")[0]).alias("name"), box.alias("box"), (c("p")[5].cast("double") >= 0).alias("inside"))


def places(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """Names of place paths (without the first three characters, separators as blanks) and whether they are outdoors (kind 2)."""
    return rows.withColumn("name", F.translate(F.substr(path, F.lit(4)), "/_", "  ")).withColumn("outdoor", c(kind) == "2")


def usable_blocks(blocks: DataFrame, files: DataFrame, counts: DataFrame, item: str, boxes: str, labelled: Column) -> DataFrame:
    """Frames of two boxes or more with a usable label, of the items whose files and blocks differ by one at most."""
    fit = files.join(counts, item).where(F.abs(c("files") - c("blocks")) <= 1).select(item)
    return blocks.where((F.size(boxes) >= 2) & labelled).join(fit, item, "left_semi")


def blocks(rows: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """(file, head, values, names): a line of one token opens a block, later lines belong to it; whole numbers and other tokens apart."""
    words = F.array_remove(F.split(F.trim(F.col(text)), r"\s+"), "")
    w = Window.partitionBy(file).orderBy(order)
    marked = rows.withColumn("words", words).where("size(words) > 0").withColumn("head_", F.when(F.size("words") == 1, F.expr("try_cast(words[0] as int)")))
    filled = marked.withColumn("head", F.last("head_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("size(words) > 1")
    number = lambda x: x.rlike(r"^-?\d+$")
    return filled.select(file, order, "head", F.transform(F.filter("words", number), lambda x: x.cast("int")).alias("values"), F.filter("words", lambda x: ~number(x)).alias("names"))


def embedded_json(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """A delimited table whose ``columns`` (name to DDL) hold JSON."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    for name, ddl in columns.items():
        df = df.withColumn(name, F.from_json(name, ddl))
    return df


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Keys still to be computed: what a memo lacks."""
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def refreshed(wanted: DataFrame, have: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """A memo with new rows added and rows no longer wanted left out."""
    return have.join(wanted.select(*keys).distinct(), keys, "left_semi").unionByName(computed)


def seeded_sample(df: DataFrame, key: str, used: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` rows that were not used before, in the order of a seeded hash."""
    return df.join(used.select(key).distinct(), key, "left_anti").orderBy(uniform(seed, key), key).limit(count)


class Models:
    """The boundary to inference: a registered function turns batches of frames into rows of a fixed schema; it runs where the data is."""

    def __init__(self):
        self._known: dict[str, tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], str]] = {}

    def register(self, name: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> None:
        self._known[name] = (run, schema)

    def apply(self, name: str, frames: DataFrame) -> DataFrame:
        run, schema = self._known[name]
        return frames.mapInPandas(run, schema)
