"""Records of text files of any size, read by ranges of bytes.

Spark's text reader deals a file out by ranges and gives each line to the range it begins in. Whether a line lies within quotes depends on all quotes before it, so a first pass counts
each range's quotes, and the parity of the ranges before it tells in which state a range begins. In the second pass each range makes records of its lines; pieces of
records that cross a cut, at most two a range, are put together by file. No file is ever one row or one task, and results don't depend on where files are cut.

A record goes on over line ends within quotes; it ends at \\n, \\r or both elsewhere. Blank lines are no records. A file that ends within quotes is broken and gives none. Bytes that are no UTF-8
become U+FFFD. Files of no bytes aren't seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.functions.lineage import cut

#: Ranges that begin within quotes and broken files that are sent to all tasks, and bytes of headers; beyond, rows are sorted and joined by shuffle.
MOST_RANGES, MOST_BYTES = 100_000, 64 << 20

#: A record of a file that is cut at bare \\r.
_RECORD = r'((?:"(?:[^"]|"")*"|[^"\r\n])+)'


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, at, value): the lines of files, at being where a line's range begins; within a task the lines of a range are in order."""
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.make_valid_utf8("value").alias("value"))


class _Lines:
    """Lines put together as records, from a state within quotes or not."""

    def __init__(self, inside: bool):
        self.inside, self.left, self.held = inside, inside, []

    def add(self, line: str) -> list[tuple[str, bool, bool]]:
        """Records (text, goes on from before, goes on after) that end with this line."""
        self.inside ^= line.count('"') % 2 == 1
        if self.inside:
            self.held.append(line)
            return []
        if self.held or self.left:
            line = "\n".join([*self.held, line])
        left, self.left, self.held = self.left, False, []
        return [(line, True, False)] if left else [(x, False, False) for x in pieces(line)]

    def end(self) -> list[tuple[str, bool, bool]]:
        return [("\n".join(self.held), self.left, True)] if self.held else []


def pieces(line: str) -> list[str]:
    """The records of a line, which is one, or several where bare \\r ends them."""
    line = line.removesuffix("\r")
    if "\r" in line:
        return re.findall(_RECORD, line)
    return [line] if line else []


def _ranges(text: DataFrame) -> DataFrame:
    """(path, at, n, odd, head, open): of each range its lines, whether its quotes are odd, and in the first one of a file the first record, or that it doesn't end there; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for path, at, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (path, at) != key:
                    key = path, at
                    state, row = _Lines(False), [path, at, 0, False, None, False]
                    rows.append(row)
                row[2] += 1
                row[3] ^= line.count('"') % 2 == 1
                if at == 0 and row[4] is None and (found := state.add(line)):
                    row[4] = found[0][0]
                row[5] = at == 0 and row[4] is None
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "at", "n", "odd", "head", "open"])

    return cut(text.mapInArrow(run, "path string, at long, n long, odd boolean, head string, open boolean"))


def _starts(ranges: DataFrame) -> DataFrame:
    """Adds to each range how many lines of its file come before it, and whether it begins within quotes."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return ranges.withColumns({"first_line": earlier(F.col("n")), "inside": earlier(F.col("odd").cast("int")) % 2 == 1})


def _joined(text: DataFrame, facts: DataFrame, small: bool) -> DataFrame:
    """text with the facts of its range, lines of a range still together and in order."""
    if small:
        return text.join(F.broadcast(facts), ["path", "at"], "left")
    placed = text.withColumn("_place", F.monotonically_increasing_id()).join(facts, ["path", "at"], "left")
    return placed.repartition("path", "at").sortWithinPartitions("path", "at", "_place").drop("_place")


def _sent(df: DataFrame, most: int) -> DataFrame:
    """A checkpointed table, sent to what it is joined with if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= most else df


_PLACE = ["at", "seq", "sub"]


class Files:
    """Text files as records: `records` (path, at, seq, sub, record), in the order of (at, seq, sub) within a file, and `heads` (path, broken, head, head_place) with the first record of each file."""

    def __init__(self, spark: SparkSession, path: str, glob: str | None = None):
        text = lines(spark, path, glob)
        ranges = _ranges(text)
        inside = cut(_starts(ranges).where("inside").select("path", "at", "inside"))
        files = ranges.groupBy("path").agg((F.sum(F.col("odd").cast("int")) % 2 == 1).alias("broken"), F.max(F.when(F.col("at") == 0, F.col("head"))).alias("head"), (F.max("open") & (F.count("*") > 1)).alias("open"))
        files = cut(files.withColumn("head_place", F.when(F.col("head").isNotNull(), F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("sub")))))
        broken = _sent(cut(files.where("broken").select("path")), MOST_RANGES)
        self.records = self._records(text, inside).join(broken, "path", "left_anti")
        late = files.where("open and not broken").select("path")
        if not late.isEmpty():  # the first record isn't in the first range: it is looked for among the records of these files
            first = self.records.join(_sent(cut(late), MOST_RANGES), "path", "left_semi").groupBy("path").agg(F.min(F.struct(*_PLACE, "record")).alias("_first"))
            files = files.join(first, "path", "left").withColumns({"head": F.coalesce("head", F.col("_first.record")), "head_place": F.coalesce("head_place", F.struct(*[F.col(f"_first.{c}").alias(c) for c in _PLACE]))})
        self.heads = cut(files.select("path", "broken", F.when(~F.col("broken"), F.col("head")).alias("head"), "head_place"))

    @staticmethod
    def _records(text: DataFrame, inside: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state, seq = None, None, 0
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            names = ["path", "at", "seq", "record", "left", "right"]

            def batch(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            for b in batches:
                rows = []
                for path, at, line, within in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (path, at) != key:
                        rows += [(*key, seq + k, *x) for k, x in enumerate(state.end())] if state else []
                        key, state, seq = (path, at), _Lines(bool(within)), 0
                    for x in state.add(line):
                        rows.append((path, at, seq, *x))
                        seq += 1
                if rows:
                    yield batch(rows)
            if state and (rest := state.end()):
                yield batch([(*key, seq + k, *x) for k, x in enumerate(rest)])

        small = inside.count() <= MOST_RANGES
        rows = _joined(text, inside, small).select("path", "at", "value", "inside").mapInArrow(run, "path string, at long, seq long, record string, left boolean, right boolean")
        if inside.isEmpty():  # no record crosses a cut
            return rows.select("path", "at", "seq", F.lit(0).alias("sub"), "record")
        whole = rows.where("not left and not right").select("path", "at", "seq", F.lit(0).alias("sub"), "record")
        parts = rows.where("left or right").withColumn("chain", F.sum(F.when(F.col("left"), 0).otherwise(1)).over(Window.partitionBy("path").orderBy("at", "seq")))
        parts = parts.groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "record"))).alias("p"))  # of one record
        joined = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
        found = F.posexplode(F.regexp_extract_all(joined, F.lit(_RECORD), F.lit(1))).alias("sub", "record")
        parts = parts.select("path", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["seq"].alias("seq"), found)
        return whole.unionByName(parts)


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, value, line_no): lines with their place in their file, from 0, whatever the size of the file."""
    text = lines(spark, path, glob)
    starts = cut(_starts(_ranges(text)).select("path", "at", "first_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for b in batches:
            numbers = []
            for path, at, first in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                key, n = ((path, at), first) if (path, at) != key else (key, n + 1)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(numbers, pa.int64())], ["path", "value", "line_no"])

    rows = _joined(text, starts, starts.count() <= MOST_RANGES)
    return rows.select("path", "at", "value", "first_line").mapInArrow(run, "path string, value string, line_no long")


def below_heads(files: Files, usable: Column) -> DataFrame:
    """(path, head, cells): the records of files whose header (head, an array of its cells) is usable, without the header; headers are sent to all tasks if they are no more than MOST_BYTES."""
    heads = files.heads.where("head is not null").withColumn("head", cells(F.col("head"))).where(usable).select("path", "head", "head_place")
    size = files.heads.agg(F.sum(F.length("path") + F.length("head"))).first()[0] or 0
    rows = files.records.join(F.broadcast(heads) if size <= MOST_BYTES else heads, "path")
    return rows.where(F.struct(*_PLACE) != F.col("head_place")).select("path", "head", cells(F.col("record")).alias("cells"))


def cells(record: Column) -> Column:
    """The cells of a record, quotes taken off."""
    quoted = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'
    n = F.regexp_count(F.regexp_replace(record, r'"(?:[^"]|"")*"', ""), F.lit(",")) + 1
    bare = lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(F.slice(F.regexp_extract_all(record, F.lit(quoted), F.lit(1)), F.lit(1), n), bare)
