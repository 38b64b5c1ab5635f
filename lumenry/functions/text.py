"""Column expressions over texts, keys and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The instruction sent with each sentence. Our own wording of the contract: goals or 0, then True or False.
INSTRUCTION = (
    "Read the sentence from a company report. Answer with one list: the numbers (1 to 17) of the sustainable development goals that it is about, "
    "or 0 if it is about none, and last True if it is about artificial intelligence, else False. Examples: [3, 4, True] [13, False] [0, True]"
)


def strip(text: Column) -> Column:
    """Without white space of any alphabet at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def prefix(text: Column, n: int = 10_000) -> Column:
    return F.substring(text, 1, n)


def digits_number(key: Column) -> Column:
    """The digits of a key read as one number; 0 without digits."""
    return F.coalesce(F.nullif(F.regexp_replace(key, r"\D", ""), F.lit("")).cast("long"), F.lit(0).cast("long"))


def custom_id(sentence_id: Column, company: Column, year: Column) -> Column:
    return F.concat_ws("||", F.lit("task"), sentence_id.cast("string"), company, year.cast("string"))


def custom_id_parts(value: Column) -> Column:
    """struct(sentence_id, company, year) of strings; nulls with fewer than four parts, further parts are ignored."""
    parts = F.split(value, r"\|\|", -1)
    part = lambda i: F.when(F.size(parts) >= 4, F.get(parts, F.lit(i)))
    return F.struct(part(1).alias("sentence_id"), part(2).alias("company"), part(3).alias("year"))


def request(custom: Column, sentence: Column, model: str, instruction: str = INSTRUCTION, max_tokens: int = 50) -> Column:
    """One request line as JSON; characters beyond ASCII are kept."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(instruction)), message("user", sentence)).alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    return F.to_json(F.struct(custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


RESPONSE = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField("response", T.StructType([T.StructField("status_code", T.IntegerType()), T.StructField("body", T.StructType([T.StructField("choices", T.StringType())]))])),
    ]
)


def content(line: Column) -> Column:
    """The answer in a response line: status 200, first choice, a string or the text of a first part; else null.

    Variants tell a string that looks like a list from a list, which JSON text cannot.
    """
    doc = F.try_parse_json(line)
    at = "$.response.body.choices[0].message.content"
    found = F.try_variant_get(doc, at, "variant")
    kind = F.schema_of_variant(found)
    text = F.when(kind == "STRING", F.try_variant_get(doc, at, "string"))
    part = F.when(kind.startswith("ARRAY") & (F.schema_of_variant(F.try_variant_get(doc, f"{at}[0].text", "variant")) == "STRING"), F.try_variant_get(doc, f"{at}[0].text", "string"))
    return F.when(F.try_variant_get(doc, "$.response.status_code", "int") == 200, F.coalesce(text, part))


def line_id(line: Column) -> Column:
    """The custom_id of a response line; null if it is absent, empty or the line is no JSON."""
    return F.nullif(F.try_variant_get(F.try_parse_json(line), "$.custom_id", "string"), F.lit(""))


#: Fixed value: how the log of submitted jobs writes an id.
JOB_ID = r"batch_job\.id:\s*([a-zA-Z0-9_\-]+)"


def job_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, JOB_ID, 1), F.lit(""))


def report_line(*fields: Column) -> Column:
    return F.concat_ws("||", *[F.coalesce(f.cast("string"), F.lit("-")) for f in fields])


def word_tokens(text: Column) -> Column:
    """Number of white-space tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def line_count(text: Column) -> Column:
    """Number of lines; a line end at the end begins no other."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\\R", -1)) - F.when(t.rlike(r"\R\z"), 1).otherwise(0)).cast("long")


def path_key(path: Column) -> Column:
    """struct(company, year) from .../company/year/file; url escapes are undone."""
    parts = F.split(path, "/")
    part = lambda k: F.url_decode(F.when(F.size(parts) >= -k, F.element_at(parts, k)))
    return F.struct(part(-3).alias("company"), part(-2).alias("year"))
