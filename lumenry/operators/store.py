"""The results table: loading, its exploded view, updates and compaction, without a table format that has transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField("sdgs", T.ArrayType(T.IntegerType())),
        T.StructField("is_ai", T.BooleanType()),
        T.StructField("raw", T.StringType()),
        T.StructField("batch_id", T.StringType()),
    ]
)


def create(spark: SparkSession, name: str = "results") -> None:
    """The table, if it isn't there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], RESULTS).write.format("parquet").saveAsTable(name)


def duplicates(rows: DataFrame, key: str = "custom_id") -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def append(rows: DataFrame, name: str = "results") -> None:
    """Adds rows by name; refuses all of them if a custom_id would occur twice. Of the table only ids that meet the new ones are looked at."""
    spark = rows.sparkSession
    rows = rows.select(*RESULTS.names)
    met = spark.table(name).select("custom_id").join(rows.select("custom_id"), "custom_id", "left_semi")
    if not duplicates(rows).isEmpty() or not met.isEmpty():
        raise ValueError("a custom_id occurs twice")
    rows.write.mode("append").insertInto(name)


def exploded(results: DataFrame) -> DataFrame:
    """A row for each goal; rows without goals vanish."""
    return results.select("custom_id", F.explode("sdgs").alias("sdg"), "is_ai", "raw", "batch_id")


def create_view(spark: SparkSession, name: str = "results", view: str = "results_exploded") -> None:
    exploded(spark.table(name)).createOrReplaceTempView(view)


def updated(results: DataFrame, updates: DataFrame, key: str = "custom_id", columns: dict[str, str] | None = None) -> DataFrame:
    """results with the columns of matching updates (new name by old); matched nulls replace too."""
    columns = columns or {"raw": "new_raw", "sdgs": "new_sdgs", "is_ai": "new_ai"}
    u = updates.select(F.col(key).alias("_u_key"), *[F.col(n).alias(f"_u_{o}") for o, n in columns.items()])
    joined = results.join(u, F.col(key) == F.col("_u_key"), "left")
    hit = F.col("_u_key").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in results.columns])


def replace(rows: DataFrame, name: str = "results") -> None:
    """Puts rows in place of the table's. They are written whole to a folder of their own, to which the table is then pointed in one step, so readers
    find the old rows or the new ones and a crash leaves the old ones; rows may derive from the table. The old files go last.
    """
    spark = rows.sparkSession
    old = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"] if spark.catalog.tableExists(name) else None
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/versions/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    if old is None:
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
        return
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.sql(f"REFRESH TABLE {name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def compact(spark: SparkSession, name: str = "results", file_bytes: int = 256 << 20) -> None:
    """Rewrites the table in files of about so many bytes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"])
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    replace(spark.table(name).repartition(max(1, -(-size // file_bytes))), name)
