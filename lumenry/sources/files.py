"""Report folders, sentence maps, score files, response lines and logs as DataFrames.

Keys come from paths: .../<company>/<year>/<file>. Readers are lazy; a missing log gives an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.functions.scores import numeric
from lumenry.functions.text import content, line_id, path_key
from lumenry.sources import ranges

PATH = "_metadata.file_path"


def year_as(text: Column, kind: str = "tolerant") -> Column:
    """A path's year as a number that must be one (strict), as it is written (string), or null where it is none (tolerant)."""
    number = text.try_cast("int")
    return {"strict": F.coalesce(number, F.raise_error(F.concat(F.lit("no year: "), F.coalesce(text, F.lit("none"))))), "string": text.cast("string"), "tolerant": number}[kind]


def _keyed(df: DataFrame, *values: Column, year: str = "tolerant", path: str = PATH) -> DataFrame:
    """company, year (see year_as), path and the values."""
    key = path_key(F.col(path))
    return df.select(key["company"].alias("company"), year_as(key["year"], year).alias("year"), F.col(path).alias("path"), *values)


def report_texts(spark: SparkSession, root: str, name: str = "*results.txt", year: str = "tolerant") -> DataFrame:
    """(company, year, path, text) of whole files in any depth; any name that ends in results.txt counts, as in a suffix test. Bytes that are no UTF-8 fail."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return _keyed(df, F.validate_utf8("value").alias("text"), year=year)


def lenient_texts(spark: SparkSession, root: str, name: str = "results.txt", year: str = "tolerant") -> DataFrame:
    """As report_texts, from bytes of <root>/<company>/<year>/<name>: those that are no UTF-8 are dropped, files that can't be read are left out. No file at all is an error."""
    try:
        df = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(f"{root.rstrip('/')}/*/*/{name}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no {name} two levels below {root}") from e
    # U+FFFD that stands in the file is set aside as two noncharacters while the one that marks bad bytes is dropped.
    aside, mark = F.lit("\ufdd0\ufdd1"), F.lit("\ufffd")
    text = F.make_valid_utf8(F.replace(F.col("content").cast("string"), mark, aside))
    return _keyed(df, F.replace(F.replace(text, mark, F.lit("")), aside, mark).alias("text"), year=year)


def sentences(spark: SparkSession, root: str, name: str = "splits.json", year: str = "tolerant") -> DataFrame:
    """(company, year, path, sentence_id, sentence) from JSON objects of id and sentence; empty maps give no row."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    maps = _keyed(df, F.from_json("value", "map<string,string>").alias("m"), year=year)
    return maps.select("company", "year", "path", F.explode("m").alias("k", "sentence")).select("company", "year", "path", F.col("k").try_cast("int").alias("sentence_id"), "sentence")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, ord) of a JSON object of strings; of a key given twice the last value stands."""
    text = spark.read.text(path, wholetext=True)
    keys = text.select(F.posexplode(F.json_object_keys("value")).alias("ord", "key"), F.from_json("value", "map<string,string>").alias("m"))
    return keys.groupBy("key").agg(F.max("ord").alias("ord"), F.first("m").alias("m")).select("key", F.element_at("m", F.col("key")).alias("value"), "ord")


def unusable_scores(spark: SparkSession, root: str, id_column: str = "sentence_id", year: str = "tolerant", glob: str = "*.csv") -> DataFrame:
    """(company, year, path, reason) of score files that give no rows; files of no bytes are passed over by the reader."""
    head = ranges.cells(F.col("head"))
    reason = F.when(F.col("broken"), "ends within quotes").when(F.col("head").isNull(), "empty").when(~F.array_contains(head, id_column), "no id column").when(F.size(head) < 2, "no score column")
    return _keyed(ranges.Files(spark, root, glob).heads, reason.alias("reason"), year=year, path="path").where("reason IS NOT NULL")


def _scored(spark: SparkSession, root: str, id_column: str, year: str, glob: str, *values: Column) -> DataFrame:
    """company, year, path, sentence_id and the values, which may use head and cells, of each record of the score files that have the id column."""
    rows = ranges.below_heads(ranges.Files(spark, root, glob), F.array_contains("head", id_column))
    at = F.array_position("head", id_column).cast("int")
    return _keyed(rows, F.get("cells", at - 1).try_cast("int").alias("sentence_id"), *values, year=year, path="path")


def score_rows(spark: SparkSession, root: str, id_column: str = "sentence_id", year: str = "tolerant", glob: str = "*.csv") -> DataFrame:
    """(company, year, path, sentence_id, ref_key, ord, score) from wide score files of any size, each with a header of its own.

    Records and cells are told apart by pattern, quotes included, against their own file's header, so names that have dots, commas or line ends or differ by
    case only stay apart. Cells that are no numbers are null; files that can't be read, or lack the id column, give no rows (see unusable_scores).
    """
    long = _scored(spark, root, id_column, year, glob, F.posexplode(F.arrays_zip("head", "cells")).alias("ord", "x"))
    return long.where(F.col("x.head") != id_column).select("company", "year", "path", "sentence_id", F.col("x.head").alias("ref_key"), "ord", numeric(F.col("x.cells")).alias("score"))


def score_arrays(spark: SparkSession, root: str, names: list[str], id_column: str = "sentence_id", year: str = "tolerant", glob: str = "*.csv") -> DataFrame:
    """(company, year, path, sentence_id, scores): the scores of these references, in this order, as one array a sentence; null where a file lacks the column."""
    scores = F.transform(F.array(*map(F.lit, names)), lambda n: numeric(F.get("cells", F.array_position("head", n).cast("int") - 1)))
    return _scored(spark, root, id_column, year, glob, scores.alias("scores"))


def responses(spark: SparkSession, folder: str, audit: bool = False) -> DataFrame:
    """(custom_id, content, batch_id) of batch_*.jsonl. For loading, lines without an id or a good answer go; an audit keeps those that are JSON."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    lines = spark.read.option("pathGlobFilter", "batch_*.jsonl").text(folder).select("value", name.alias("batch_id"))
    rows = lines.where(F.trim("value") != "").where(F.try_parse_json("value").isNotNull())
    rows = rows.select(line_id(F.col("value")).alias("custom_id"), content(F.col("value")).alias("content"), "batch_id")
    return rows if audit else rows.where("custom_id IS NOT NULL AND content IS NOT NULL")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a log of any size; empty if there is none."""
    try:
        return ranges.numbered_lines(spark, path).select("value", "line_no")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], "value string, line_no long")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(company, year) of all folders of two levels, those without files too."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return spark.createDataFrame([(s.getPath().getParent().getName(), s.getPath().getName()) for s in found if s.isDirectory()], "company string, year string")


def with_year(df: DataFrame, kind: str = "tolerant", year: str = "year") -> DataFrame:
    """df with a year that is text in one of the forms of year_as. Readers take the form themselves, as `year`."""
    return df.withColumn(year, year_as(F.col(year), kind))
