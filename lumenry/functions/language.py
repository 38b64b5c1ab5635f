"""The language of a text by naive Bayes over its character triples, learned from texts of known language.

Learning is one aggregation: how often each of BUCKETS classes of triples occurs in each language. The model is these counts turned into whole numbers (thousandths of log probabilities), of a size that neither texts nor
languages of a corpus change, so it is a literal of the expression that scores a text; no Python runs. A triple's class comes from the code points of its characters, A-Z lower-cased; texts of
fewer than three characters go by how common the languages are. Equal sums go to the language that sorts first. A null text has the language of an empty one; rows without a language aren't learned from.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of triples (a prime), and the factors of their first and second characters.
BUCKETS, FIRST, SECOND = 4099, 961, 31
#: Weights are thousandths.
UNIT = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def triples(text: Column) -> Column:
    """The classes of a text's triples in order; characters beyond the basic plane count as one."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[^\x{0}-\x{FFFF}]", "?")
    points = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def classes(p: Column) -> Column:
        at = lambda k: F.slice(p, k, F.greatest(F.size(p) - 2, F.lit(0)))
        return F.zip_with(F.zip_with(at(1), at(2), lambda x, y: x * FIRST + y * SECOND), at(3), lambda s, c: F.pmod(s + c, F.lit(BUCKETS)))

    return F.transform(F.array(points), classes)[0]  # as the only element, the code points are made once for all their uses


def counts(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): occurrences of each class of triples in the texts of each language; bucket null counts the texts."""
    own = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), triples(F.col(text)).alias("t"))
    grams = own.select("lang", F.explode("t").alias("bucket")).groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    return grams.unionByName(own.groupBy("lang").agg(F.count("*").alias("n")).withColumn("bucket", F.lit(None).cast("int")))


class Model:
    """Languages in order, a prior weight for each, and a weight for each class of triples and language."""

    def __init__(self, languages: list[str], prior: list[int], weights: list[list[int]]):
        self.languages, self.prior, self.weights = languages, prior, weights

    def scores(self, text: Column) -> Column:
        """The weight of each language, in order."""
        own = [F.from_json(F.lit(json.dumps(w)), "array<int>") for w in self.weights]
        each = lambda w, p, t: F.aggregate(t, F.lit(p).cast("long"), lambda s, k: s + F.get(w, k))
        return F.transform(F.array(triples(text)), lambda t: F.array(*[each(w, p, t) for w, p in zip(own, self.prior, strict=True)]))[0]

    def language(self, text: Column) -> Column:
        names = F.array(*map(F.lit, self.languages))
        # With its scores as the only element, the array is made once for both of its uses.
        return F.transform(F.array(self.scores(text)), lambda s: F.get(names, F.array_position(s, F.array_max(s)).cast("int") - 1))[0]

    def is_german(self, text: Column) -> Column:
        return self.language(text) == "de"

    def saved(self, spark: SparkSession, path: str) -> None:
        rows = [(n, p, w) for n, p, w in zip(self.languages, self.prior, self.weights, strict=True)]
        spark.createDataFrame(rows, "lang string, prior int, weights array<int>").coalesce(1).write.mode("overwrite").parquet(path)


def opened(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("lang").collect()  # a row for each language
    return Model([r.lang for r in rows], [r.prior for r in rows], [list(r.weights) for r in rows])


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all texts; at most BUCKETS + 1 sums for each language reach the driver."""
    found: dict[str, dict] = {}
    for r in counts(texts, text, lang).toLocalIterator():
        found.setdefault(r["lang"], {})[r["bucket"]] = r["n"]
    if not found:
        raise ValueError("no text has a language")
    names = sorted(found)
    total = sum(x[None] for x in found.values())
    weight = lambda p: round(UNIT * math.log(p))
    weights = []
    for name in names:
        own = found[name]
        size = sum(n for k, n in own.items() if k is not None) + BUCKETS
        weights.append([weight((own.get(k, 0) + 1) / size) for k in range(BUCKETS)])
    return Model(names, [weight(found[name][None] / total) for name in names], weights)


def held_out(texts: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, found, n): how many texts of each language were found to have which."""
    return texts.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"), model.language(F.col(text)).alias("found")).agg(F.count("*").alias("n"))
