"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of text.

A section ends after a blank line, a paragraph after a line end, a piece after a sentence's end or 80 code points;
nothing of the text is left out, so the pieces joined are the text. A piece's hash is SHA-256 of its bytes; a
paragraph's, section's and the root's are SHA-256 of its children's. The fingerprint string holds the root (64
hex digits) and of all other nodes 8 digits: `root:section=paragraph~leaves-paragraph~leaves/section=...`, with `-` between paragraphs and `/`
between sections. Roots test equality; where they differ, branches are compared downwards: only those unlike are opened, which gives the likeness of two
texts and locates edits.

Null texts count as empty; the empty text has a root of its own and no leaves. Repeated rows are equal in all results; a
null doc_id comes last in descending order; an empty table gives an empty result; a single document is its own
next. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.llm.common import settle, text_of

PIECE = r"(?s).{0,79}?[.!?]\s+|.{1,80}"
LEAF = 8


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tree(text: Column) -> Column:
    """Sections as arrays of paragraphs as arrays of piece hashes."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), _sha)
    paragraphs = lambda s: F.transform(F.split(s, r"(?<=\n)", -1), pieces)
    return F.filter(F.transform(F.split(text, r"(?<=\n\n)(?!\n)", -1), lambda s: F.filter(paragraphs(s), lambda p: F.size(p) > 0)), lambda s: F.size(s) > 0)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of fingerprints a and b, 0 to 1: twice the leaves they share by the sum of both; 1 if the roots are equal.

    Leaves of equal sections count together, then, within the unlike ones, those of equal paragraphs, then distinct equal leaves.
    """
    sections = lambda c: F.when(F.length(c) > 65, F.array_distinct(F.split(F.substring(c, 66, 2**31 - 1), "/"))).otherwise(F.array().cast("array<string>"))
    paragraphs = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda s: F.split(F.substring(s, LEAF + 2, 2**31 - 1), "-"))))
    leaves = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x: F.regexp_extract_all(F.substring(x, LEAF + 2, 2**31 - 1), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))))
    of = lambda c: F.aggregate(c, F.lit(0.0), lambda n, x: n + (F.length(x) - (LEAF + 1)) / LEAF)
    x, y = (F.col(f"_f_{c}") for c in "xy")
    df = df.withColumns({"_f_x": sections(F.col(a)), "_f_y": sections(F.col(b))})
    df = df.withColumns({"_f_same": F.flatten(F.transform(F.array_intersect(x, y), lambda s: F.split(F.substring(s, LEAF + 2, 2**31 - 1), "-"))), "_f_x": paragraphs(F.array_except(x, y)), "_f_y": paragraphs(F.array_except(y, x))})
    df = df.withColumns({"_f_same": of(F.col("_f_same")) + of(F.array_intersect(x, y)), "_f_x": leaves(F.array_except(x, y)), "_f_y": leaves(F.array_except(y, x))})
    shared = F.col("_f_same") + F.size(F.array_intersect(x, y))
    whole = 2 * F.col("_f_same") + F.size(x) + F.size(y)
    equal = F.substring(F.col(a), 1, 64) == F.substring(F.col(b), 1, 64)
    return df.withColumn(name, F.when(equal, F.lit(1.0)).otherwise(F.coalesce(2.0 * shared / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))).drop("_f_same", "_f_x", "_f_y")


def _first_unlike(a: Column, b: Column) -> Column:
    """The first place at which two arrays differ, from 0; null if they don't."""
    return F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(0))


def first_edit(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with edit_section, edit_paragraph and edit_leaf (int): where fingerprint b first differs from a, by opening the first unlike branch of each level; null if the roots are equal."""
    body = lambda c: F.when(F.substring(F.col(a), 1, 64) != F.substring(F.col(b), 1, 64), F.split(F.substring(F.col(c), 66, 2**31 - 1), "/"))
    x, y = (F.col(f"_f_{c}") for c in "xy")
    inside = lambda c, at, mark: F.split(F.substring(F.coalesce(F.get(c, F.col(at)), F.lit("")), LEAF + 2, 2**31 - 1), mark)
    leaves = lambda c, at: F.regexp_extract_all(F.substring(F.coalesce(F.get(c, F.col(at)), F.lit("")), LEAF + 2, 2**31 - 1), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))
    df = df.withColumns({"_f_x": body(a), "_f_y": body(b)}).withColumn("edit_section", _first_unlike(x, y))
    df = df.withColumns({f"_f_{c}": inside(F.col(f"_f_{c}"), "edit_section", "-") for c in "xy"}).withColumn("edit_paragraph", F.when(F.col("edit_section").isNotNull(), _first_unlike(x, y)))
    df = df.withColumns({f"_f_{c}": leaves(F.col(f"_f_{c}"), "edit_paragraph") for c in "xy"})
    return df.withColumn("edit_leaf", F.when(F.col("edit_section").isNotNull(), _first_unlike(x, y))).drop("_f_x", "_f_y")


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint b differs from a: (section, paragraph) numbers from 0 of b's paragraphs that are not at that place in a.

    Sections whose hashes are equal are passed over whole.
    """
    sections = lambda c: F.split(F.substring(c, 66, 2**31 - 1), "/")
    paragraphs = lambda s: F.split(F.substring(F.coalesce(s, F.lit("")), LEAF + 2, 2**31 - 1), "-")
    old = sections(a)

    def within(s: Column, i: Column) -> Column:
        was = paragraphs(F.get(old, i))
        changed = F.filter(F.transform(paragraphs(s), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~p.eqNullSafe(F.get(was, j))).alias("new"))), lambda x: x["new"])
        same = F.coalesce(F.substring(s, 1, LEAF) == F.substring(F.get(old, i), 1, LEAF), F.lit(False))
        return F.when(same, F.lit([]).cast("array<struct<section:int,paragraph:int>>")).otherwise(F.transform(changed, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"))))

    return F.flatten(F.transform(sections(b), within))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text."""
    short = lambda h: F.substring(h, 1, LEAF)
    joined = lambda c, f, mark="": F.array_join(F.transform(c, f), mark)
    paragraph = lambda p: F.struct(_sha(F.array_join(p, "")).alias("h"), joined(p, short).alias("leaves"))
    section = lambda s: F.struct(_sha(joined(s, lambda p: p["h"])).alias("h"), joined(s, lambda p: F.concat(short(p["h"]), F.lit("~"), p["leaves"]), "-").alias("inner"))
    df = docs.withColumn("_f_tree", tree(text_of(text)))
    df = df.withColumn("_f_tree", F.transform("_f_tree", lambda s: F.transform(s, paragraph)))
    df = df.withColumn("_f_tree", F.transform("_f_tree", section))
    whole = F.concat(_sha(joined("_f_tree", lambda s: s["h"])), F.lit(":"), joined("_f_tree", lambda s: F.concat(short(s["h"]), F.lit("="), s["inner"]), "/"))
    return df.withColumn(name, whole).drop("_f_tree")


def _followers(keys: DataFrame) -> DataFrame:
    """(doc_id, th, before_id, before_th, before_chars): each key with the key it follows in descending doc_id, round from last to first.

    Keys are sorted over all partitions by ranges; only the first and last key of each partition are looked at together.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    dealt = settle(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    me = F.struct("doc_id", "th", "n_chars")
    inside = Window.partitionBy("part").orderBy(*order)
    ranked = dealt.withColumns({"before": F.lag(me).over(inside), "place": F.row_number().over(inside)})
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("th"), me.alias("key"))
    ends = dealt.groupBy("part").agg(F.max(place)["key"].alias("last"))
    around = Window.orderBy("part")
    last_of_all = F.last("last").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("last").over(around), last_of_all).alias("prior"))
    out = ranked.join(ends, "part").withColumn("b", F.coalesce(F.when(F.col("place") > 1, F.col("before")), F.col("prior")))
    return out.select("doc_id", "th", F.col("b.doc_id").alias("before_id"), F.col("b.th").alias("before_th"), F.col("b.n_chars").alias("before_chars"))


def edited_with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and where the edit begins: edit_section, edit_paragraph, edit_leaf.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document's in descending
    doc_id (after the last: the first). Texts move once by their own key, and once as the beginnings that edits need.
    """
    own = docs.select("doc_id", text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    narrow = settle(own.select("doc_id", "th", F.length("t").alias("n_chars")))
    keys = narrow.distinct()
    follows = settle(_followers(keys))
    f = follows.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "before_id", "before_th", "before_chars")
    heads = own.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    heads = fingerprints(heads, "t", "next_fingerprint").select(
        "before_id", "before_th", F.substring(F.col("t"), F.lit(1), F.floor(F.col("before_chars") / 2).cast("int")).alias("head"), "next_fingerprint"
    )
    if narrow.count() != keys.count():  # repeated rows would pair with each other's heads
        heads = heads.groupBy("before_id", "before_th").agg(F.first("head").alias("head"), F.first("next_fingerprint").alias("next_fingerprint"))
    out = own.join(heads, F.col("doc_id").eqNullSafe(F.col("before_id")) & (F.col("th") == F.col("before_th")))
    n = F.length("t")
    out = out.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("t"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head"))})
    out = fingerprints(fingerprints(out, "t"), "edited", "edited_fingerprint")
    out = out.select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    out = likeness(likeness(out, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return first_edit(out, "fingerprint", "edited_fingerprint").drop("next_fingerprint")
