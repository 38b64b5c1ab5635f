"""Registry of the engine's queries and of the SQL that checks them.

Test tables play the engine's inputs: `embeddings` are sentence vectors (company c<label>, year 2015 + id % 8), its first 46 rows the
references; `documents` are reports (company = source), their lines sentences; `events` by user are batch jobs; answers
are drawn from a fixed list by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.functions import language
from lumenry.functions import scores as S
from lumenry.functions import text as X
from lumenry.functions.answers import answered
from lumenry.functions.lineage import scratch
from lumenry.operators import batching, blocks, buckets, cube, references, reports, sampling, scoring, store
from lumenry.sources import files, job_stream, sinks
from lumenry.streaming import tracking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N_REFS, N_GOALS = 46, 17


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scores ----------------------------------------------------------------------------------------

S_SQL = "s AS (SELECT vec_id AS sentence_id, 'c' || label AS company, CAST(2015 + vec_id % 8 AS INTEGER) AS year, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
R_SQL = "r AS (SELECT vec_id AS ord, CASE WHEN vec_id < 17 THEN 'sdg_' || (vec_id + 1) ELSE 'ai_' || vec_id END AS ref_key, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < 46)"
P_SQL = f"WITH {S_SQL}, {R_SQL}, p AS (SELECT s.sentence_id, s.company, s.year, r.ord, r.ref_key, round_even(list_dot_product(s.vec, r.vec), 2) + 0.0 AS score FROM s, r)"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sentence_id"), F.concat(F.lit("c"), "label").alias("company"), (F.lit(2015) + F.col("vec_id") % 8).cast("int").alias("year"), F.col("embedding").alias("vec"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("vec_id") < N_GOALS, F.concat(F.lit("sdg_"), F.col("vec_id") + 1)).otherwise(F.concat(F.lit("ai_"), "vec_id"))
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < N_REFS).select(F.col("vec_id").alias("ord"), key.alias("ref_key"), F.col("embedding").alias("vec"))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Sentences with their score arrays, and the references' keys."""
    keys, matrix = scoring.reference_table(refs(spark, sf_dir))
    return scoring.with_scores(sentences(spark, sf_dir), matrix), keys


@query(f"{P_SQL} SELECT sentence_id, ref_key, score FROM p")
def pair_scores(spark, sf_dir):
    rows, keys = scored(spark, sf_dir)
    return scoring.long_scores(rows, keys).select("sentence_id", "ref_key", "score")


@query(f"{P_SQL}, n AS (SELECT CAST(count(*) AS BIGINT) AS n_rows FROM s), h AS (SELECT t.theta, count(DISTINCT sentence_id) AS k FROM (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) t(theta), p WHERE score >= theta GROUP BY 1) SELECT h.theta, n.n_rows, CAST(h.k AS BIGINT) AS n_selected FROM h, n")
def threshold_counts(spark, sf_dir):
    return reports.threshold_counts(scored(spark, sf_dir)[0], [0.2, 0.3, 0.4, 0.5])


COVER_SQL = "SELECT {by}, CAST(count(*) AS BIGINT) AS total_rows, CAST(sum(hit::INT) AS BIGINT) AS selected FROM (SELECT sentence_id, company, year, max(score) >= {theta} AS hit FROM p WHERE {where} GROUP BY ALL) GROUP BY {by}"


@query(f"{P_SQL} {COVER_SQL.format(by='company', theta=0.3, where='true')}")
def firm_coverage(spark, sf_dir):
    return reports.coverage(scored(spark, sf_dir)[0], 0.3, ["company"])


@query(f"{P_SQL} SELECT company, year, total_rows FROM ({COVER_SQL.format(by='company, year', theta=0.4, where='true')}) WHERE selected = 0")
def firms_zero_coverage(spark, sf_dir):
    return reports.uncovered(reports.coverage(scored(spark, sf_dir)[0], 0.4, ["company", "year"])).select("company", "year", "total_rows")


@query(f"{P_SQL} SELECT company, selected FROM ({COVER_SQL.format(by='company', theta=0.3, where='true')}) ORDER BY selected DESC, company LIMIT 10")
def top_firms(spark, sf_dir):
    return reports.top(reports.coverage(scored(spark, sf_dir)[0], 0.3, ["company"])).select("company", "selected")


@query(f"WITH {R_SQL}, c AS (SELECT CASE WHEN ord % 2 = 0 THEN upper(ref_key) ELSE ref_key END AS name, ord FROM r UNION ALL SELECT ref_key, ord + 100 FROM r WHERE ord % 3 = 0), a AS (SELECT ref_key FROM r WHERE ord % 5 < 3) SELECT lower(name) AS key, arg_max(name, ord) AS name, max(ord) AS ord FROM c WHERE lower(name) IN (SELECT lower(ref_key) FROM a) GROUP BY 1")
def select_ci_columns(spark, sf_dir):
    r = refs(spark, sf_dir)
    columns = r.select(F.when(F.col("ord") % 2 == 0, F.upper("ref_key")).otherwise(F.col("ref_key")).alias("name"), "ord").union(r.where(F.col("ord") % 3 == 0).select("ref_key", F.col("ord") + 100))
    return references.resolve_columns(columns, r.where(F.col("ord") % 5 < 3).select(F.col("ref_key").alias("term")))


@query(f"{P_SQL} SELECT sentence_id, bool_or(score > 0.2) AND bool_or(score < 0.4) AS is_low, bool_or(score >= 0.4) AS is_high, CASE WHEN bool_or(score >= 0.4) THEN 'score>=0.4' ELSE '0.2<score<0.4' END AS bucket FROM p GROUP BY 1")
def bucket_low_high(spark, sf_dir):
    s = F.col("scores")
    return scored(spark, sf_dir)[0].select("sentence_id", S.is_low(s, 0.2, 0.4).alias("is_low"), S.is_high(s, 0.4).alias("is_high"), S.bucket_label(s, 0.2, 0.4).alias("bucket"))


@query(f"{P_SQL} SELECT sentence_id, ref_key, score FROM p QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY score DESC, ord) = 1")
def argmax_ref(spark, sf_dir):
    rows, keys = scored(spark, sf_dir)
    return reports.best_reference(rows, keys).select("sentence_id", "ref_key", "score")


PICKS_SQL = f"""{P_SQL}, g AS (SELECT p.sentence_id, company, year, bool_or(score > 0.2) AND bool_or(score < 0.4) AS low, bool_or(score >= 0.4) AS high, arg_max(ref_key, score * 1000 - ord / 1000.0) AS ref_key, max(score) AS score
    FROM p JOIN documents d ON d.doc_id = p.sentence_id WHERE coalesce(d.text, '') <> '' GROUP BY ALL),
    f AS (SELECT *, min(CASE WHEN low THEN sentence_id END) OVER u AS fl, min(CASE WHEN high THEN sentence_id END) OVER u AS fh FROM g WHERE low OR high WINDOW u AS (PARTITION BY company, year)),
    k AS (SELECT *, CASE WHEN sentence_id = fl THEN 0 WHEN sentence_id = fh THEN 1 ELSE 2 END AS kind FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY kind, sentence_id) AS rank FROM k),
    z AS (SELECT company, year, CAST(rank AS INTEGER) AS rank, CASE kind WHEN 0 THEN '0.2<score<0.4' WHEN 1 THEN 'score>=0.4' ELSE CASE WHEN high THEN 'score>=0.4' ELSE '0.2<score<0.4' END END AS bucket, sentence_id, ref_key, score FROM o WHERE rank <= 2)"""


@query(f"{PICKS_SQL} SELECT * FROM z")
def sentence_picks(spark, sf_dir):
    rows, keys = scored(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), "text")
    return reports.examples(rows.join(texts, "sentence_id"), keys, ["company", "year"], 0.2, 0.4).select("company", "year", "rank", "bucket", "sentence_id", "ref_key", "score")


@query(f"{PICKS_SQL} SELECT company, year, rank, company || '/' || year || ' #' || rank || ' [' || bucket || '] sentence ' || sentence_id || ': ' || ref_key || ' = ' || printf('%.3f', score) AS line FROM z")
def example_lines(spark, sf_dir):
    rows, keys = scored(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), "text")
    return reports.example_lines(reports.examples(rows.join(texts, "sentence_id"), keys, ["company", "year"], 0.2, 0.4), ["company", "year"])


@query(f"WITH {R_SQL}, q AS (SELECT vec FROM r WHERE ord = 17) SELECT ref_key, round(list_cosine_similarity(r.vec, q.vec), 6) + 0.0 AS similarity FROM r, q WHERE list_cosine_similarity(r.vec, q.vec) >= 0.05")
def glossary_filter(spark, sf_dir):
    r = refs(spark, sf_dir)
    alike = references.glossary(r, r.where(F.col("ord") == N_GOALS).select(F.col("vec").alias("q")), 0.05)
    return alike.select("ref_key", (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


@query(f"WITH {S_SQL} SELECT sentence_id, round(sqrt(list_dot_product(vec, vec)), 6) AS norm, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) + 0.0 AS first FROM s")
def normalized_vectors(spark, sf_dir):
    return sentences(spark, sf_dir).select("sentence_id", F.round(S.norm("vec"), 6).alias("norm"), (F.round(S.normalized("vec")[0], 6) + F.lit(0.0)).alias("first"))


# --- references of any number, and counts at any threshold ---------------------------------------------

G_SQL = f"WITH {S_SQL}, r AS (SELECT vec_id AS ord, 'v' || vec_id AS ref_key, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), p AS (SELECT s.sentence_id, s.company, s.year, r.ord, r.ref_key, round_even(list_dot_product(s.vec, r.vec), 2) + 0.0 AS score FROM s, r)"
THETAS = [k / 20 for k in range(21)]
THETAS_SQL = "t AS (SELECT CAST(k AS DOUBLE) / 20 AS theta FROM range(21) x(k))"


def grid(spark: SparkSession, sf_dir: str) -> blocks.Grid:
    """All vectors against all vectors."""
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.concat(F.lit("v"), "vec_id").alias("ref_key"), F.col("embedding").alias("vec"))
    return blocks.Grid(sentences(spark, sf_dir), every, group=1 << 9, block=1 << 8)


@query(f"{G_SQL} SELECT sentence_id, ref_key, score FROM p QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY score DESC, ord) = 1")
def block_best(spark, sf_dir):
    return blocks.best(grid(spark, sf_dir), ["sentence_id"]).select("sentence_id", "ref_key", "score")


@query(f"{G_SQL} SELECT sentence_id, ref_key, score FROM p WHERE score >= 0.45")
def block_pairs(spark, sf_dir):
    return blocks.pairs_at_least(grid(spark, sf_dir), 0.45, ["sentence_id"]).select("sentence_id", "ref_key", "score")


@query(f"{G_SQL}, {THETAS_SQL}, n AS (SELECT CAST(count(*) AS BIGINT) AS n_rows FROM s), m AS (SELECT sentence_id, max(score) AS score FROM p GROUP BY 1) SELECT theta, n_rows, (SELECT count(*) FROM m WHERE score >= theta) AS n_selected FROM t, n")
def block_threshold_counts(spark, sf_dir):
    return blocks.threshold_counts(grid(spark, sf_dir), THETAS)


def scores_cube(spark: SparkSession, sf_dir: str) -> tuple[cube.Cube, list[str]]:
    rows, keys = scored(spark, sf_dir)
    return cube.build(rows, ["company", "year"]), keys


@query(f"{P_SQL}, {THETAS_SQL}, m AS (SELECT company, year, sentence_id, max(score) AS score FROM p GROUP BY ALL) SELECT company, year, theta, count(*) AS total_rows, count(*) FILTER (score >= theta) AS selected FROM m, t GROUP BY ALL")
def cube_coverage(spark, sf_dir):
    return cube.coverage(scores_cube(spark, sf_dir)[0], THETAS)


@query(f"{P_SQL}, m AS (SELECT company, sentence_id, bool_or(score > 0.2) AND bool_or(score < 0.4) AS low, bool_or(score >= 0.4) AS high FROM p GROUP BY ALL) SELECT company, count(*) FILTER (low) AS n_low, count(*) FILTER (high) AS n_high FROM m GROUP BY 1")
def cube_buckets(spark, sf_dir):
    return cube.buckets(scores_cube(spark, sf_dir)[0], 0.2, 0.4, ["company"])


@query(f"{P_SQL}, {THETAS_SQL} SELECT ref_key, theta, count(*) AS n_rows, count(*) FILTER (score >= theta) AS selected FROM p, t GROUP BY ALL")
def cube_reference_coverage(spark, sf_dir):
    made, keys = scores_cube(spark, sf_dir)
    return cube.reference_coverage(made, THETAS, []).select(F.get(F.array(*map(F.lit, keys)), F.col("ref")).alias("ref_key"), "theta", "n_rows", "selected")


@query(f"{P_SQL}, h AS (SELECT company, ref_key, list_sort(list(score)) AS h FROM p GROUP BY ALL) SELECT company, ref_key, len(h) AS n_rows, h[CAST(greatest(ceil(0.5::DOUBLE * len(h)), 1) AS BIGINT)] AS median, h[CAST(greatest(ceil(0.95::DOUBLE * len(h)), 1) AS BIGINT)] AS high FROM h")
def cube_quantiles(spark, sf_dir):
    made, keys = scores_cube(spark, sf_dir)
    rows = cube.quantiles(made, [0.5, 0.95], ["company"])
    return rows.select("company", F.get(F.array(*map(F.lit, keys)), F.col("ref")).alias("ref_key"), "n_rows", F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("high"))


# --- dictionaries ------------------------------------------------------------------------------------

KEYS = ["1", "2", "10", "11", "17", "1.1", "1.2", "2.1", "12", "12.1", "3.10", "x"]
KEYS_SQL = ", ".join(f"('{k}', {i})" for i, k in enumerate(KEYS))


@query(f"SELECT key, 'sdg_' || key AS \"column\", CAST(row_number() OVER (ORDER BY coalesce(try_cast(regexp_replace(key, '[^0-9]', '', 'g') AS BIGINT), 0), ord) - 1 AS INTEGER) AS place FROM (VALUES {KEYS_SQL}) t(key, ord)")
def sdg_key_order(spark, sf_dir):
    given = spark.createDataFrame([(k, i) for i, k in enumerate(KEYS)], "key string, ord int")
    return references.goal_order(given).select("key", "column", "place")


@query("SELECT trim(n_name) AS term FROM nation WHERE trim(n_name) <> '' UNION SELECT trim(' ' || r_name || ' ') FROM region UNION SELECT lower(n_name) FROM nation")
def term_set(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return references.terms((nation, F.array("n_name", F.lower("n_name"))), (region, F.concat(F.lit(" "), "r_name", F.lit(" "))))


@query("WITH b AS (SELECT c_nationkey AS key, min(c_name) AS value, 0 AS k FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_name), 1 FROM supplier GROUP BY 1) SELECT key, arg_max(value, k) AS value FROM b GROUP BY 1")
def map_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("value"))
    over = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("value"))
    return references.merged(base, over)


# --- texts -------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS ref_lang, CAST(length(substring(text, 1, 10000)) AS BIGINT) AS n_prefix FROM documents")
def lang_routing(spark, sf_dir):
    return scoring.routed(table(spark, sf_dir, "documents")).select("doc_id", "ref_lang", F.length(X.prefix(F.col("text"))).cast("long").alias("n_prefix"))


LINES_SQL = "l AS (SELECT doc_id, source, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS sentence FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))"


@query(f"WITH {LINES_SQL} SELECT doc_id, pos, sentence FROM l WHERE sentence <> ''")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "sentence")).where("sentence <> ''")


@query("SELECT source AS company, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def token_counts(spark, sf_dir):
    return reports.token_totals(table(spark, sf_dir, "documents").withColumnRenamed("source", "company"), X.word_tokens(F.col("text")))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT source) AS BIGINT) AS n_companies FROM documents")
def firm_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_companies"))


@query("SELECT 'task||' || turn || '||' || role || '||' || conv_id AS custom_id, CAST(turn AS VARCHAR) AS sentence_id, role AS company, CAST(conv_id AS INTEGER) AS year FROM conversations")
def custom_id_roundtrip(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(X.custom_id(F.col("turn"), F.col("role"), F.col("conv_id")).alias("custom_id"))
    return ids.withColumn("p", X.custom_id_parts(F.col("custom_id"))).select("custom_id", "p.sentence_id", "p.company", F.col("p.year").cast("int").alias("year"))


@query("SELECT 'task||' || turn || '||' || role || '||' || conv_id AS custom_id, 'model-x' AS model, CAST(2 AS INTEGER) AS n_messages, text AS sentence, CAST(50 AS INTEGER) AS max_tokens FROM conversations WHERE text <> ''")
def request_json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text <> ''")
    line = X.request(X.custom_id(F.col("turn"), F.col("role"), F.col("conv_id")), F.col("text"), "model-x")
    rows = rows.select(line.alias("line"))
    get = lambda p: F.get_json_object("line", p)
    return rows.select(get("$.custom_id").alias("custom_id"), get("$.body.model").alias("model"), F.json_array_length(get("$.body.messages")).alias("n_messages"), get("$.body.messages[1].content").alias("sentence"), get("$.body.max_tokens").cast("int").alias("max_tokens"))


RESPONSE_KINDS = 7


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' END AS content FROM documents")
def response_extract(spark, sf_dir):
    k, t = F.col("doc_id") % RESPONSE_KINDS, F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.regexp_extract(t, r'(?s)^\{"t":(.*)\}$', 1)
    wrap = lambda status, choices: F.concat(F.lit('{"custom_id":"x","response":{"status_code":' + status + ',"body":{"choices":'), choices, F.lit("}}}"))
    one = lambda content: F.concat(F.lit('[{"message":{"content":'), content, F.lit("}}]"))
    line = (
        F.when(k == 0, wrap("200", one(quoted)))
        .when(k == 1, wrap("200", one(F.concat(F.lit('[{"type":"text","text":'), quoted, F.lit("}]")))))
        .when(k == 2, wrap("200", one(F.lit('""'))))
        .when(k == 3, wrap("500", one(quoted)))
        .when(k == 4, wrap("200", F.lit("[]")))
        .when(k == 5, wrap("200", one(F.lit("null"))))
        .otherwise(F.lit("{not json"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", X.content(F.col("line")).alias("content"))


# --- answers -----------------------------------------------------------------------------------------

#: Fixed cases in order: answer (n stands for doc_id % 17 + 1), stored goals, flag, reason, repaired answer, its goals, its flag. A dash: null; `=`: unchanged.
CASES = [
    ("[n, 5, True]", "n,5", "T", "-", "=", "", ""),
    ("[0, True]", "", "T", "-", "=", "", ""),
    ("[0, 3, True]", "", "T", "0 with other numbers", "[0, False]", "", "F"),
    ("[0, 0, False]", "", "F", "0 with other numbers", "[0, False]", "", "F"),
    ("[n, 5]", "n,5", "-", "last element not boolean", "[n, 5, False]", "n,5", "F"),
    ("[18, 3]", "3", "-", "last element not boolean", "[18, 3, False]", "3", "F"),
    ("[18, True]", "", "T", "SDG out of range: 18", "[0, False]", "", "F"),
    ("[0, 18, True]", "", "T", "SDG out of range: 18", "[0, False]", "", "F"),
    ("[n]", "n", "-", "too few elements", "=", "", ""),
    ("[True]", "", "T", "too few elements", "=", "", ""),
    ("[]", "", "-", "too few elements", "=", "", ""),
    ("[1, True, False]", "1,1", "F", "multiple boolean classifications", "=", "", ""),
    ("[1, False, True]", "", "T", "multiple boolean classifications", "[0, False]", "", "F"),
    ("[n, True/False]", "", "-", "could not parse list literal", "[n, False]", "n", "F"),
    ("[8, 0 False]", "", "-", "could not parse list literal", "[0, False]", "", "F"),
    ("[n False]", "", "-", "could not parse list literal", "[n, False]", "n", "F"),
    ("[9 True]", "", "-", "could not parse list literal", "=", "", ""),
    ("SDGs: [n, 4, True].", "n,4", "T", "-", "=", "", ""),
    ("1, 5, True", "1,5", "T", "invalid list format", "=", "", ""),
    ("5", "", "-", "invalid list format", "=", "", ""),
    ("[3, true]", "", "-", "could not parse list literal", "=", "", ""),
    ("['3', True]", "3", "T", "-", "=", "", ""),
    ("[2.7, True]", "2", "T", "-", "=", "", ""),
    ("['abc', True]", "", "T", "could not parse list literal", "=", "", ""),
    ("['abc', 0, 2, True]", "", "T", "could not parse list literal", "[0, False]", "", "F"),
    ("[n, True] or [2, False]", "", "-", "could not parse list literal", "[n, True]", "n", "T"),
    ("[3, 4", "", "-", "could not parse list literal", "=", "", ""),
    ("", "", "-", "could not parse list literal", "=", "", ""),
    ("-", "", "-", "could not parse list literal", "=", "", ""),
    ("[-1, True]", "", "T", "SDG out of range: -1", "[0, False]", "", "F"),
    ("[1, n, True]", "1,n", "T", "-", "=", "", ""),
    ("[ True/False]", "", "-", "could not parse list literal", "[0, False]", "", "F"),
    ("[3, 4 true/false]", "", "-", "could not parse list literal", "[3, 4, False]", "3,4", "F"),
    ("[17, 19 False]", "", "-", "could not parse list literal", "[17, False]", "17", "F"),
    ("[1, 5, None]", "1,5", "-", "last element not boolean", "[1, 5, False]", "1,5", "F"),
    ("[0, 'x']", "", "-", "last element not boolean", "[0, False]", "", "F"),
    ("[1, True], [2, False]", "", "-", "invalid list format", "=", "", ""),
]


def _case_sql(column: int, null: str) -> str:
    """A CASE over the fixed values of one column, with n put in; `null` stands for null."""
    quote = lambda v: "NULL" if v == null else "replace('" + v.replace("'", "''") + "', 'n', n)"
    safe = lambda v: quote(v) if any(t in v for t in ("n,", "[n", " n", ",n")) or v in ("n", null) else "'" + v.replace("'", "''") + "'"
    plain = lambda v: "NULL" if v == null else f"'{v}'"
    put = plain if column == 3 else safe
    return "CASE k " + " ".join(f"WHEN {i} THEN {put(c[column])}" for i, c in enumerate(CASES)) + " END"


_FLAG_SQL = "CASE {} WHEN 'T' THEN true WHEN 'F' THEN false END"
A_SQL = f"""a AS (SELECT doc_id, source, k, {_case_sql(0, '-')} AS raw, {_case_sql(1, '-')} AS sdgs, {_FLAG_SQL.format('(' + _case_sql(2, '-') + ')')} AS is_ai, {_case_sql(3, '-')} AS reason,
    {_case_sql(4, '=')} AS new_raw, CASE WHEN ({_case_sql(4, '=')}) IS NOT NULL THEN {_case_sql(5, '-')} END AS new_sdgs, {_FLAG_SQL.format('(' + _case_sql(6, '-') + ')')} AS new_ai
    FROM (SELECT doc_id, source, doc_id % {len(CASES)} AS k, CAST(doc_id % 17 + 1 AS VARCHAR) AS n FROM documents))"""


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, raw): the fixed answers by doc_id."""
    n = (F.col("doc_id") % 17 + 1).cast("string")
    put = lambda v: F.lit(None).cast("string") if v == "-" else (F.replace(F.lit(v), F.lit("n"), n) if any(t in v for t in ("n,", "[n", " n")) else F.lit(v))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.get(F.array(*[put(c[0]) for c in CASES]), (F.col("doc_id") % len(CASES)).cast("int")).alias("raw"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(raw_answers(spark, sf_dir)).select("doc_id", "source", "raw", "answer.*")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table that these answers give; nulls aren't loaded."""
    rows = answers(spark, sf_dir).where("raw IS NOT NULL")
    return rows.select(X.custom_id(F.col("doc_id"), F.col("source"), F.lit(2020)).alias("custom_id"), "sdgs", "is_ai", "raw", F.concat(F.lit("batch_"), F.col("doc_id") % 7).alias("batch_id"))


RES_SQL = f"WITH {A_SQL}, res AS (SELECT doc_id, 'task||' || doc_id || '||' || source || '||2020' AS custom_id, sdgs, is_ai, raw, 'batch_' || (doc_id % 7) AS batch_id, new_raw, new_sdgs, new_ai FROM a WHERE raw IS NOT NULL)"


@query(f"WITH {A_SQL} SELECT doc_id, raw, sdgs, is_ai FROM a")
def answer_parse(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", "raw", F.array_join("sdgs", ",").alias("sdgs"), "is_ai")


@query(f"WITH {A_SQL} SELECT doc_id, coalesce(reason, 'ok') AS reason FROM a")
def answer_reason(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(f"WITH {A_SQL} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM a WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason")
def reason_counts(spark, sf_dir):
    return reports.reason_counts(answers(spark, sf_dir))


@query(f"WITH {A_SQL} SELECT doc_id, new_raw IS NOT NULL AS changed, new_raw, new_sdgs, new_ai FROM a")
def answer_fix(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", "changed", "new_raw", F.array_join("new_sdgs", ",").alias("new_sdgs"), "new_ai")


EXPLODED_SQL = f"{RES_SQL}, ex AS (SELECT custom_id, CAST(unnest(string_split(sdgs, ',')) AS INTEGER) AS sdg, is_ai, raw, batch_id FROM res WHERE sdgs <> '')"


@query(f"{EXPLODED_SQL} SELECT * FROM ex")
def results_exploded(spark, sf_dir):
    return store.exploded(results(spark, sf_dir))


@query(f"{EXPLODED_SQL} SELECT sdg, is_ai, CAST(count(*) AS BIGINT) AS n FROM ex GROUP BY 1, 2")
def sdg_distribution(spark, sf_dir):
    return store.exploded(results(spark, sf_dir)).groupBy("sdg", "is_ai").agg(F.count("*").alias("n"))


@query(f"{RES_SQL} SELECT custom_id, coalesce(new_raw, raw) AS raw, CASE WHEN new_raw IS NOT NULL THEN new_sdgs ELSE sdgs END AS sdgs, CASE WHEN new_raw IS NOT NULL THEN new_ai ELSE is_ai END AS is_ai, batch_id FROM res")
def update_from(spark, sf_dir):
    from lumenry.plans.stages import repaired

    return repaired(results(spark, sf_dir)).select("custom_id", "raw", F.array_join("sdgs", ",").alias("sdgs"), "is_ai", "batch_id")


@query(f"WITH {A_SQL} SELECT a.doc_id, a.doc_id || '||' || coalesce(nullif(d.text, ''), '<sentence not found>') || '||' || coalesce(a.raw, '-') AS line, a.reason FROM a LEFT JOIN documents d USING (doc_id) WHERE a.reason IS NOT NULL")
def invalid_with_sentence(spark, sf_dir):
    """The invalid answers with their sentences."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sentence"))
    rows = reports.with_sentence(answers(spark, sf_dir).where("reason IS NOT NULL"), found, ["doc_id"])
    return rows.select("doc_id", X.report_line(F.col("doc_id"), F.col("sentence"), F.col("raw")).alias("line"), "reason")


@query(f"WITH {A_SQL}, z AS (SELECT doc_id, reason, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS p FROM a WHERE reason = '0 with other numbers') SELECT doc_id, reason FROM z WHERE p <= 5 UNION ALL SELECT doc_id, reason FROM a WHERE reason IS NOT NULL AND reason <> '0 with other numbers'")
def invalid_sample(spark, sf_dir):
    rows = answers(spark, sf_dir).where("reason IS NOT NULL").select("doc_id", "reason")
    return sampling.sample_of(rows, "reason", "0 with other numbers", "doc_id", 5)


ITEMS_SQL = """w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS w, coalesce(length(text), 0) AS c FROM documents),
    f AS (SELECT doc_id, '[' || array_to_string(list_concat(list_transform(range(w % 5), lambda k: CAST((c + w * k + doc_id) % 23 - 2 AS VARCHAR)), [[], ['True'], ['False'], ['True', 'False']][c % 4 + 1]), ', ') || ']' AS raw FROM w),
    i AS (SELECT doc_id, raw, regexp_extract_all(raw, '-?[0-9]+|True|False') AS i FROM f),
    h AS (SELECT *, len(i) AS n, coalesce(i[-1] IN ('True', 'False'), false) AS flagged FROM i),
    v AS (SELECT *, CASE WHEN flagged THEN i[-1] = 'True' END AS is_ai, CASE WHEN flagged THEN i[:-2] ELSE i END AS goals FROM h),
    x AS (SELECT *, list_transform(goals, lambda g: CASE g WHEN 'True' THEN 1 WHEN 'False' THEN 0 ELSE CAST(g AS INTEGER) END) AS nums FROM v),
    y AS (SELECT *, coalesce(list_contains(nums, 0), false) AS zero, list_filter(nums, lambda k: k BETWEEN 1 AND 17) AS real, list_filter(nums, lambda k: k < 0 OR k > 17)[1] AS beyond FROM x),
    a AS (SELECT *, CASE WHEN n < 2 THEN 'too few elements' WHEN NOT flagged THEN 'last element not boolean' WHEN len(list_filter(goals, lambda g: g IN ('True', 'False'))) > 0 THEN 'multiple boolean classifications'
        WHEN beyond IS NOT NULL THEN 'SDG out of range: ' || beyond WHEN zero AND len(nums) > 1 THEN '0 with other numbers' END AS reason FROM y),
    b AS (SELECT *, CASE WHEN reason IS NULL THEN NULL WHEN zero AND len(nums) > 1 THEN '[0, False]' WHEN reason = 'last element not boolean' THEN '[' || CASE WHEN zero OR len(nums) = 0 THEN '0' ELSE array_to_string(nums, ', ') END || ', False]'
        WHEN starts_with(reason, 'SDG out of range') THEN '[0, False]' END AS new_raw FROM a)"""


def varied_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): lists of numbers made from each document's words and length, with no, one or two flags."""
    words, size = X.word_tokens(F.col("text")), F.coalesce(F.length("text"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(words, F.lit(0)).cast("int").alias("w"), size.alias("c"))
    numbers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k < F.col("w") % 5, ((F.col("c") + F.col("w") * k + F.col("doc_id")) % 23 - 2).cast("string"))), lambda x: x.isNotNull())
    flags = F.when(F.col("c") % 4 == 0, F.array().cast("array<string>")).when(F.col("c") % 4 == 1, F.array(F.lit("True"))).when(F.col("c") % 4 == 2, F.array(F.lit("False"))).otherwise(F.array(F.lit("True"), F.lit("False")))
    return docs.select("doc_id", F.concat(F.lit("["), F.array_join(F.concat(numbers, flags), ", "), F.lit("]")).alias("raw"))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, raw, CASE WHEN zero THEN '' ELSE array_to_string(real, ',') END AS sdgs, is_ai, coalesce(reason, 'ok') AS reason, coalesce(new_raw, raw) AS fixed FROM b")
def answers_computed(spark, sf_dir):
    """Answers of any numbers, read, audited and repaired."""
    rows = answered(varied_answers(spark, sf_dir))
    return rows.select("doc_id", "raw", F.array_join("answer.sdgs", ",").alias("sdgs"), "answer.is_ai", F.coalesce("answer.reason", F.lit("ok")).alias("reason"), F.coalesce("answer.new_raw", "raw").alias("fixed"))


@query(f"WITH {ITEMS_SQL}, e AS (SELECT unnest(CASE WHEN zero THEN [] ELSE real END) AS sdg, is_ai FROM b) SELECT sdg, is_ai, count(*) AS n FROM e GROUP BY ALL")
def goals_computed(spark, sf_dir):
    """Goals of these answers by flag, as the exploded table has them."""
    rows = answered(varied_answers(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("custom_id"), "answer.sdgs", "answer.is_ai", "raw", F.lit("b").alias("batch_id"))
    return store.exploded(rows).groupBy("sdg", "is_ai").agg(F.count("*").alias("n"))


@query("SELECT source || '.' || doc_id AS key, 'sdg_' || source || '.' || doc_id AS \"column\", CAST(row_number() OVER (ORDER BY coalesce(try_cast(regexp_replace(source || '.' || doc_id, '[^0-9]', '', 'g') AS BIGINT), 0), doc_id) - 1 AS INTEGER) AS place FROM documents WHERE source IS NOT NULL")
def key_order(spark, sf_dir):
    """Keys made of each document's source and id, in the order of their digits."""
    given = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.concat_ws(".", "source", "doc_id").alias("key"), F.col("doc_id").alias("ord"))
    return references.goal_order(given).select("key", "column", "place")


# --- units, batches, jobs ----------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 20)


@query("WITH c AS (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50) SELECT c.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'results/' || c.doc_id END, '') AS dest_results, coalesce(CASE WHEN e.vec_id IS NOT NULL THEN 'splits/' || c.doc_id END, '') AS dest_splits FROM c LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = c.doc_id")
def sample_manifest(spark, sf_dir):
    chosen = sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)
    have = lambda df, key, name: df.select(F.col(key).alias("doc_id"), F.concat(F.lit(f"{name}/"), key).alias("path"))
    return sampling.manifest(chosen, have(table(spark, sf_dir, "labels"), "doc_id", "results"), have(table(spark, sf_dir, "embeddings"), "vec_id", "splits"), "doc_id")


@query("WITH c AS (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50) SELECT CAST(count(*) AS BIGINT) AS folders, CAST(count(*) FILTER (l.doc_id IS NULL OR e.vec_id IS NULL) AS BIGINT) AS incomplete FROM c LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = c.doc_id")
def sample_incomplete(spark, sf_dir):
    return sampling.incomplete(sample_manifest(spark, sf_dir))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    from lumenry.sources.sinks import unfinished

    return unfinished(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def paired_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("WITH b AS (SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 20000 AS BIGINT) AS batch_no FROM lineitem) SELECT batch_no, CAST(count(*) AS BIGINT) AS n_lines, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM b GROUP BY 1")
def batch_rotation(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = batching.rotated(table(spark, sf_dir, "lineitem").select(*order), order)
    return rows.groupBy("batch_no").agg(F.count("*").alias("n_lines"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


JOBS_SQL = """WITH j AS (SELECT 'job_' || user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'ERROR' WHEN user_id % 3 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CAST(count(*) AS BIGINT) AS total, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS completed, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS failed FROM events GROUP BY user_id),
    t AS (SELECT * FROM j UNION ALL SELECT 'OVERALL', '-', CAST(sum(total) AS BIGINT), CAST(sum(completed) AS BIGINT), CAST(sum(failed) AS BIGINT) FROM j WHERE status <> 'ERROR'), st AS (SELECT *, greatest(total - completed - failed, 0) AS remain FROM t)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as batch jobs with counts of their events."""
    u = F.col("user_id")
    state = F.when(u % 5 == 0, "ERROR").when(u % 3 == 0, "in_progress").otherwise("completed")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return rows.select(F.concat(F.lit("job_"), u).alias("id"), state.alias("status"), F.struct("total", "completed", "failed").alias("request_counts")).select("id", "status", *batching.job_counts("request_counts"))


@query(f"{JOBS_SQL} SELECT * FROM st")
def batch_status(spark, sf_dir):
    return batching.status(jobs(spark, sf_dir))


@query(f"{JOBS_SQL}, sh AS (SELECT id, status, list_transform([total, completed, failed, remain], lambda c: CASE WHEN status = 'ERROR' THEN '-' ELSE CAST(c AS VARCHAR) END) AS c FROM st) SELECT printf('%-38s %-12s %7s %7s %7s %7s', id, status, c[1], c[2], c[3], c[4]) AS line FROM sh")
def batch_status_lines(spark, sf_dir):
    return batching.status_lines(batching.status(jobs(spark, sf_dir)))


@query(f"{JOBS_SQL} SELECT id, total FROM (SELECT * FROM j ORDER BY id LIMIT 100) WHERE status = 'in_progress'")
def in_progress_jobs(spark, sf_dir):
    return batching.in_progress(jobs(spark, sf_dir)).select("id", "total")


@query("SELECT 'batch_' || (user_id % 50) AS id, min(event_id) AS line_no FROM events WHERE event_type <> 'view' GROUP BY 1")
def log_ids(spark, sf_dir):
    line = F.when(F.col("event_type") == "view", F.lit("no id here")).otherwise(F.concat(F.lit("INFO batch_job.id: batch_"), F.col("user_id") % 50, F.lit(" sent")))
    return batching.logged_ids(table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("line_no")))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(event_id % 100 AS VARCHAR) END AS DOUBLE) AS cell, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(event_id % 100 AS VARCHAR) END AS INTEGER), 0) AS count, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def numeric_coerce(spark, sf_dir):
    cell = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise((F.col("event_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.numeric(cell).alias("cell"), S.as_int(cell).alias("count"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT md5(text) AS custom_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return store.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("custom_id")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from lumenry.streaming.ingest import counted

    return counted(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- selection -----------------------------------------------------------------------------------------


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, year, sentence_id, sentence): the documents as the sentences of the scored vectors."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"))
    return sentences(spark, sf_dir).drop("vec").join(texts, "sentence_id")


SELECTED_SQL = f"{P_SQL}, c AS (SELECT sentence_id, company, year FROM p GROUP BY ALL HAVING max(score) >= 0.3), q AS (SELECT c.*, d.text AS sentence FROM c JOIN documents d ON d.doc_id = c.sentence_id WHERE d.text <> '')"


@query(f"{SELECTED_SQL} SELECT 'task||' || sentence_id || '||' || company || '||' || year AS custom_id, sentence FROM q")
def requests_selected(spark, sf_dir):
    from lumenry.plans.stages import requests

    rows = requests(scored(spark, sf_dir)[0], report_sentences(spark, sf_dir), 0.3, "model-x")
    return rows.select("custom_id", F.get_json_object("request", "$.body.messages[1].content").alias("sentence"))


@query(f"{SELECTED_SQL} SELECT CAST(count(*) AS BIGINT) AS selected, (SELECT CAST(count(DISTINCT (company, year)) AS BIGINT) FROM s) AS files, CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches FROM q")
def selection_counters(spark, sf_dir):
    return reports.selection_counts(scored(spark, sf_dir)[0], report_sentences(spark, sf_dir), 0.3, ["company", "year"], ["company", "year", "sentence_id"], 50)


WIDE = [f"sdg_{k}" for k in range(1, N_GOALS + 1)] + [f"ai_{k}" for k in range(N_GOALS, N_REFS)]


@query(f"{P_SQL} SELECT sentence_id, " + ", ".join(f"max(score) FILTER (ref_key = '{k}') AS {k}" for k in WIDE) + " FROM p GROUP BY 1")
def scores_wide(spark, sf_dir):
    """All references as columns, as a wide export has them."""
    rows, keys = scored(spark, sf_dir)
    return rows.select("sentence_id", *[F.get("scores", F.lit(keys.index(k))).alias(k) for k in WIDE])


@query(f"WITH {R_SQL}, c AS (SELECT CASE WHEN ord % 2 = 0 THEN upper(ref_key) ELSE ref_key END AS name, ord FROM r) SELECT name, ord FROM c WHERE name IN (SELECT ref_key FROM r WHERE ord % 5 < 3)")
def select_exact_columns(spark, sf_dir):
    r = refs(spark, sf_dir)
    columns = r.select(F.when(F.col("ord") % 2 == 0, F.upper("ref_key")).otherwise(F.col("ref_key")).alias("name"), "ord")
    return references.resolve_columns(columns, r.where(F.col("ord") % 5 < 3).select(F.col("ref_key").alias("term")), exact=True)


@query("SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS n_lines FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.line_count(F.col("text")).alias("n_lines"))


# --- files, tables and streams that these queries write and read back -----------------------------------


@query(f"{P_SQL} SELECT company, year, sentence_id, ref_key, score FROM p")
def csv_scores(spark, sf_dir):
    """Scores as wide files by company and year, read back by ranges."""
    rows, keys = scored(spark, sf_dir)
    path = scratch(spark, "wide")
    sinks.write_wide_csv(rows, keys, path)
    back = files.score_rows(spark, path, glob="part-*", year="string")
    value = lambda c: F.regexp_extract(c, "=(.*)$", 1)
    return back.select(value("company").alias("company"), value("year").cast("int").alias("year"), F.col("sentence_id").cast("long").alias("sentence_id"), "ref_key", (F.col("score") + F.lit(0.0)).alias("score"))


LABELLED_SQL = "l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)"


@query(f"WITH {LABELLED_SQL} SELECT 'task||' || d.doc_id || '||' || source || '||2020' AS custom_id, CASE WHEN l.doc_id IS NULL THEN md5(text) ELSE 'quality ' || quality END AS raw, CASE WHEN l.doc_id IS NULL THEN lang = 'de' ELSE quality = 1 END AS is_ai, CAST(coalesce(quality, d.doc_id % 17) AS INTEGER) AS sdg FROM documents d LEFT JOIN l USING (doc_id)")
def bucket_update(spark, sf_dir):
    """Documents as results in a table of buckets, of which the labelled ones are updated."""
    docs = table(spark, sf_dir, "documents")
    of = lambda df: df.select(X.custom_id(F.col("doc_id"), F.col("source"), F.lit(2020)).alias("custom_id"), "*")
    made = buckets.BucketTable(spark, scratch(spark, "buckets"), store.RESULTS, buckets=64)
    made.append(of(docs).select("custom_id", F.array((F.col("doc_id") % 17).cast("int")).alias("sdgs"), (F.col("lang") == "de").alias("is_ai"), F.md5("text").alias("raw"), F.lit("b").alias("batch_id")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    new = of(docs.select("doc_id", "source").join(labels, "doc_id"))
    made.update(new.select("custom_id", F.concat(F.lit("quality "), "quality").alias("new_raw"), F.array(F.col("quality").cast("int")).alias("new_sdgs"), (F.col("quality") == 1).alias("new_ai")))
    return made.read().select("custom_id", "raw", "is_ai", F.col("sdgs")[0].alias("sdg"))


@query("WITH a AS (SELECT source || '/' || lang AS custom_id, 'batch_' || (length(text) % 3) AS batch_id, md5(text) AS content FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL) SELECT custom_id, min(batch_id || ' ' || content) AS standing, count(*) AS answers, count(DISTINCT content) > 1 AS conflict FROM a GROUP BY 1")
def tracked_answers(spark, sf_dir):
    """Documents as answers to the request of their source and language, as a stream with state."""
    kind = table(spark, sf_dir, "documents").schema
    docs = lambda: spark.readStream.schema(kind).parquet(f"{sf_dir}/documents.parque[t]").where("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").withColumn("custom_id", F.concat_ws("/", "source", "lang"))
    asked = docs().select("custom_id", F.unix_millis(F.current_timestamp()).alias("asked"))
    answers_ = docs().select("custom_id", F.concat(F.lit("batch_"), F.length("text") % 3).alias("batch_id"), F.md5("text").alias("content"))
    at = scratch(spark, "tracked")
    tracking.track(asked, answers_, f"{at}/history", f"{at}/checkpoint").awaitTermination()
    return tracking.current(spark.read.parquet(f"{at}/history")).select("custom_id", F.concat_ws(" ", "batch_id", "content").alias("standing"), "answers", "conflict")


@query("SELECT * FROM (SELECT user_id AS id, event_id, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE status IS DISTINCT FROM previous")
def job_changes(spark, sf_dir):
    """Events as polled states of a job for each user."""
    polls = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "ts", F.col("event_type").alias("status"))
    return job_stream.changes_in(polls, "ts", "event_id").select("id", "event_id", "status", "previous")


# --- languages ---------------------------------------------------------------------------------------

CHARS_SQL = f"string_split(translate(regexp_replace(coalesce(text, ''), '[^\\x{{0}}-\\x{{FFFF}}]', '?', 'g'), '{language._UPPER}', '{language._LOWER}'), '')"
TRIPLES_SQL = f"""c AS (SELECT doc_id, lang, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform({CHARS_SQL}, lambda x: unicode(x)) END AS c FROM documents),
    g AS (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: (c[i] * {language.FIRST} + c[i + 1] * {language.SECOND} + c[i + 2]) % {language.BUCKETS})) AS bucket FROM c),
    n AS (SELECT lang, bucket, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {TRIPLES_SQL} SELECT lang, CAST(bucket AS INTEGER) AS bucket, n FROM n UNION ALL SELECT lang, NULL, count(*) FROM c WHERE lang IS NOT NULL GROUP BY 1")
def language_counts(spark, sf_dir):
    return language.counts(table(spark, sf_dir, "documents"))


@query(f"""WITH {TRIPLES_SQL}, z AS (SELECT lang, sum(n) + {language.BUCKETS} AS z FROM n GROUP BY 1), t AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM c WHERE lang IS NOT NULL GROUP BY 1),
    b AS (SELECT doc_id, bucket, count(*) AS k FROM g GROUP BY ALL),
    w AS (SELECT t.lang, x.bucket, CAST(round({language.UNIT} * ln((coalesce(n.n, 0) + 1) / z.z)) AS BIGINT) AS w FROM t JOIN z USING (lang) CROSS JOIN (SELECT DISTINCT bucket FROM b) x LEFT JOIN n ON n.lang = t.lang AND n.bucket = x.bucket),
    s AS (SELECT c.doc_id, t.lang AS found, CAST(round({language.UNIT} * ln(t.n / t.total)) AS BIGINT) + coalesce((SELECT sum(b.k * w.w) FROM b JOIN w ON w.bucket = b.bucket AND w.lang = t.lang WHERE b.doc_id = c.doc_id), 0) AS s FROM c, t)
    SELECT doc_id, found FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, found) = 1""")
def language_found(spark, sf_dir):
    """The language that a model of all documents finds for each of them."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", language.learn(docs).language(F.col("text")).alias("found"))


# --- without an oracle: Python on the way ------------------------------------------------------------


@query(None)
def provider_scores(spark, sf_dir):
    """Benchmark items as sentences against region and nation names, by the offline encoder."""
    from lumenry.functions.providers import embedded, hashing_encoder

    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ref_key")).union(table(spark, sf_dir, "region").select("r_name"))
    r = names.select("ref_key", embedded(F.col("ref_key"), hashing_encoder()).alias("vec"), F.col("ref_key").alias("ord"))
    keys, matrix = scoring.reference_table(r)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence_id"), embedded(F.col("text"), hashing_encoder()).alias("vec"))
    return reports.best_reference(scoring.with_scores(rows, matrix), keys).select("sentence_id", "ref_key", "score")


@query(None)
def provider_language(spark, sf_dir):
    """Documents by language and whether the offline detector finds them German."""
    from lumenry.functions.providers import is_german, word_detector

    return table(spark, sf_dir, "documents").select("lang", is_german(F.col("text"), word_detector()).alias("german")).groupBy("lang", "german").agg(F.count("*").alias("n"))


@query(None)
def vocabulary_tokens(spark, sf_dir):
    """Tokens of every company by a public vocabulary of byte pairs."""
    import public_tokenizers

    from lumenry.functions.providers import rank_file_counter, token_count

    counter = rank_file_counter(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return reports.token_totals(table(spark, sf_dir, "documents").withColumnRenamed("source", "company"), token_count(F.col("text"), counter))


@query(None)
def provider_tokens(spark, sf_dir):
    from lumenry.functions.providers import piece_counter, token_count

    return reports.token_totals(table(spark, sf_dir, "documents").withColumnRenamed("source", "company"), token_count(F.col("text"), piece_counter()))
