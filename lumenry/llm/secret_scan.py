"""Secret scans: pattern spans, and corpus-wide ownership of what they hold.

Spans of four kinds come from native expressions. Three make the base: `assign` (a key word, a sign and a value of
6 or more characters), `access` (AKIA and 16 or more), `hex` (24 or more). The fourth, `token` (28 or more, with small
and capital letters and digits), is kept only where the corpus shows it to be one owner's. Each value is reduced to a
128-bit digest; distinct (digest, owner, repository) are counted in two steps, each combined before its shuffle. A
value that `common_owners` or more distinct owners hold is a widely copied example; others look live.

Null texts count as empty and hold no span. Offsets are code points, end exclusive. Repeated rows give equal rows, and count
once for ownership; a null owner counts as one owner of its own, a null doc_id as one repository. Empty tables
give empty results; other input columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.llm.common import meet, settle, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{28,}"
KINDS = ("assign", "access", "hex", "token")
COMMON_OWNERS = 3
#: Stands for a null owner.
NO_OWNER = "(none)"
#: Documents with live-looking spans whose spans may be broadcast; with more, they are joined by shuffle.
MANY_CUT = 1_000_000


def _of_kind(number: int, regex: str, value: Column | None, keep) -> Column:
    """Matches of one kind as (kind, place, gap before, length, digest or null if dropped); empty without a match."""
    found, gaps = F.regexp_extract_all("_s_text", F.lit(regex), F.lit(0)), F.split("_s_text", regex, -1)
    pairs = F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.length(g)).alias("g"), F.sequence(F.lit(0), F.size(gaps) - 1).alias("i"))

    def one(x: Column) -> Column:
        held = F.regexp_extract(x["m"], regex, 2) if value is not None else x["m"]
        digest = F.when(keep(held), F.substring(F.sha2(held.cast("binary"), 256), 1, 32))
        return F.struct(F.lit(number).alias("kind"), x["i"].alias("i"), x["g"].alias("gap"), F.length(x["m"]).alias("len"), digest.alias("digest"))

    # arrays_zip pads the shorter side: the last gap has no match
    return F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), one)


def candidates(docs: DataFrame, owner: str = "source", repository: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, owner, repository, parts) of every row, settled; parts lists all matches."""
    t = F.col("_s_text")
    df = docs.select(F.col("doc_id"), F.col(owner).cast("string").alias("owner"), text_of(text).alias("_s_text"), *([F.col(repository).cast("string").alias("repository")] if repository else []))
    mixed = lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]")
    kinds = [
        F.when(t.rlike(ASSIGN), _of_kind(0, ASSIGN, F.lit(2), lambda x: F.length(x) >= 6)),
        F.when(t.contains("AKIA"), _of_kind(1, ACCESS, None, lambda x: F.lit(True))),
        F.when(t.rlike(HEX), _of_kind(2, HEX, None, lambda x: F.lit(True))),
        F.when(t.rlike(TOKEN), _of_kind(3, TOKEN, None, mixed)),
    ]
    none = F.lit([]).cast("array<struct<kind:int,i:int,gap:int,len:int,digest:string>>")
    parts = F.concat(*[F.coalesce(k.cast("array<struct<kind:int,i:int,gap:int,len:int,digest:string>>"), none) for k in kinds])
    of = F.col("repository") if repository else F.xxhash64("_s_text").cast("string")
    return settle(df.select("doc_id", F.xxhash64("_s_text").alias("text_hash"), "owner", of.alias("repository"), parts.alias("parts")))


def ownership(found: DataFrame, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """(digest, n, n_owners, n_repositories, common) of every value in candidates(), settled; n is its number of matches."""
    one = found.where(F.size("parts") > 0).select("owner", "repository", F.explode("parts").alias("p")).where("p.digest is not null")
    held = one.groupBy(F.col("p.digest").alias("digest"), "repository").agg(F.min(F.coalesce("owner", F.lit(NO_OWNER))).alias("owner"), F.count("*").alias("n"))
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    of = by_owner.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.max("repositories").alias("most"))
    common = (F.col("n_owners") >= common_owners) & (2 * F.col("most") <= F.col("n_repositories"))
    return settle(of.withColumn("common", common).drop("most"), narrow=True)


def spans(found: DataFrame, owned: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, common) of the spans that stand, once for each distinct (doc_id, text)."""
    one = found.where(F.size("parts") > 0).groupBy("doc_id", "text_hash").agg(F.first("parts").alias("parts"))
    p = one.select("doc_id", "text_hash", F.explode("parts").alias("p")).select("doc_id", "text_hash", "p.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("end", end).where(F.col("digest").isNotNull()).withColumn("start", F.col("end") - F.col("len"))
    out = meet(p, owned.select("digest", "n", "common"), "digest", owned.agg(F.sum("n")).first()[0] or 0)
    return out.where((F.col("kind") < 3) | ~F.col("common")).select("doc_id", "text_hash", "kind", "start", "end", "common")


def _listed(one: Column) -> Column:
    return F.array_join(F.transform(one, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, counts by kind, base and all spans as text, and how many spans look live or are common."""
    found = candidates(docs, **how)
    all_spans = spans(found, ownership(found))
    of_doc = all_spans.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "common"))).alias("s")
    )
    empty = F.lit([]).cast("array<struct<start:bigint,kind:int,end:bigint,common:boolean>>")
    out = found.select("doc_id", "text_hash").join(of_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    out = out.select("doc_id", F.coalesce("s", empty).alias("s"))
    count = lambda f: F.size(F.filter("s", f)).cast("long")
    is_kind = lambda j: lambda x: x["kind"] == j
    counts = {f"n_{k}": count(is_kind(j)) for j, k in enumerate(KINDS)}
    return out.select(
        "doc_id",
        *[c.alias(k) for k, c in counts.items()],
        F.sha2(_listed(F.filter("s", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        count(lambda x: ~x["common"]).alias("n_live"),
        count(lambda x: x["common"]).alias("n_common"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", text: str = "text", **how) -> DataFrame:
    """docs with every live-looking span replaced by `mask`; overlapping spans become one mask. Texts without one stay as they are."""
    found = candidates(docs, text=text, **how)
    live = spans(found, ownership(found)).where(~F.col("common"))
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    parts = live.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("part", F.sum("new").over(by_doc))
    parts = parts.groupBy("doc_id", "text_hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    until = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id", "text_hash").orderBy("start")), F.lit(2**31 - 1))
    cuts = parts.withColumn("until", until).groupBy(F.col("doc_id").alias("_s_d"), F.col("text_hash").alias("_s_h")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "until"))).alias("_s_cuts"))
    cuts = settle(cuts, narrow=True)
    cuts = F.broadcast(cuts) if cuts.count() <= MANY_CUT else cuts
    joined = docs.withColumn("_s_text", text_of(text)).withColumn("_s_hash", F.xxhash64("_s_text"))
    joined = joined.join(cuts, F.col("doc_id").eqNullSafe(F.col("_s_d")) & (F.col("_s_hash") == F.col("_s_h")), "left")
    t = F.col("_s_text")
    kept = F.transform("_s_cuts", lambda x: F.concat(F.lit(mask), F.substring(t, (x["end"] + 1).cast("int"), (x["until"] - x["end"]).cast("int"))))
    masked = F.concat(F.substring(t, F.lit(1), F.get("_s_cuts", F.lit(0))["start"].cast("int")), F.array_join(kept, ""))
    new = F.when(F.col("_s_cuts").isNull(), F.col(text)).otherwise(masked)
    out = joined.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_s_cuts").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
