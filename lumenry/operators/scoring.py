"""Sentence vectors against reference vectors: every pair, as one score array a sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.functions.scores import rounded

#: References come from dictionaries, so their number is small; more than this is refused rather than sent to each task.
MOST_REFERENCES = 20_000


def reference_table(refs: DataFrame, key: str = "ref_key", vector: str = "vec", order: str = "ord") -> tuple[list[str], np.ndarray]:
    """Keys and unit vectors of the references in order."""
    rows = refs.select(key, vector).orderBy(order).limit(MOST_REFERENCES + 1).collect()
    if len(rows) > MOST_REFERENCES:
        raise ValueError("too many references for one dictionary")
    m = np.array([r[1] for r in rows], np.float64)
    return [r[0] for r in rows], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def with_scores(sentences: DataFrame, matrix: np.ndarray, vector: str = "vec", name: str = "scores", places: int = 2) -> DataFrame:
    """sentences with the array of rounded dot products in place of their vector: one matrix product for each Arrow batch."""
    keep = [c for c in sentences.columns if c != vector]
    schema = T.StructType([*(sentences.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(vector))
            have = np.flatnonzero(np.asarray(column.is_valid()))
            vectors = np.asarray(column.flatten(), np.float64).reshape(len(have), -1) if len(have) else np.zeros((0, matrix.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, np.where(np.asarray(column.is_valid()), len(matrix), 0)]), pa.int32()), pa.array((vectors @ matrix.T).reshape(-1)), mask=pa.array(~np.asarray(column.is_valid())))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), lists], schema.names)

    scored = sentences.select(*keep, vector).mapInArrow(run, schema)
    return scored.withColumn(name, F.transform(name, lambda x: rounded(x, places)))


def with_maxima(scored: DataFrame, **parts: Column) -> DataFrame:
    """Adds the greatest score of each named part, so that a stored table can be filtered by it at the scan."""
    return scored.withColumns({f"max_{k}": F.array_max(v) for k, v in parts.items()})


def long_scores(scored: DataFrame, keys: list[str], name: str = "scores") -> DataFrame:
    """A row for each score: the other columns, ref_key, ord and score."""
    names = F.array(*map(F.lit, keys))
    rest = [c for c in scored.columns if c != name]
    return scored.select(*rest, F.posexplode(name).alias("ord", "score")).withColumn("ref_key", F.get(names, F.col("ord")))


def routed(reports: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds which references a report is scored with: German ones (with both glossaries) for German, else English."""
    return reports.withColumn("ref_lang", F.when(F.col(lang) == "de", "de").otherwise("en"))
