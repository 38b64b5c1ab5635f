"""Command line: one subcommand for each step, on any paths that Spark can read.

    python -m lumenry.cli score TEXTS SCORES --goals sdgs.json sdgs_detailed.json --glossary terms.json
    python -m lumenry.cli audit --from-batch-dir OUTPUTS
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenry.functions import factors, language, providers
from lumenry.functions.answers import UNREADABLE, ZERO_WITH, answered
from lumenry.functions.lineage import cut
from lumenry.functions.text import custom_id_parts
from lumenry.operators import batching, buckets, cube, references, reports, sampling, store
from lumenry.plans import stages
from lumenry.sources import files, job_stream, jobs, sinks
from lumenry.streaming import ingest, tracking


def _encoder(spark: SparkSession, a: argparse.Namespace):
    return factors.opened(spark, a.encoder).factory() if a.encoder else providers.hashing_encoder()


def learn_language(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Learns languages from a parquet table of texts (columns text, lang), and shows what it finds for them."""
    texts = spark.read.parquet(a.table)
    model = language.learn(texts)
    model.saved(spark, a.out)
    return language.held_out(texts, model).orderBy("lang", "found")


def learn_encoder(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Learns text vectors from a parquet table of texts (column text)."""
    texts = spark.read.parquet(a.table)
    factors.learn(texts, dim=a.dim).saved(spark, a.out)
    return texts.agg(F.count("*").alias("texts"))


def import_scores(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Takes wide score files over into a table of score arrays; shows the files that give nothing."""
    rows = files.score_arrays(spark, a.root, a.names)
    sinks.write_scores(rows.select("company", "year", "sentence_id", "scores"), a.scores)
    return files.unusable_scores(spark, a.root)


def histogram(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Makes the histogram of a table of scores, from which `coverage` answers any threshold."""
    cube.saved(cube.build(spark.read.parquet(a.scores), ["company", "year"]), a.cube)
    return cube.opened(spark, a.cube).extremes.agg(F.sum("n").alias("rows"))


def coverage(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return cube.coverage(cube.opened(spark, a.cube), a.thresholds, a.by).orderBy(*a.by, "theta")


def score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores the report folders that have no scores yet."""
    texts, sentences = files.report_texts(spark, a.texts), files.sentences(spark, a.texts)
    try:
        texts = sinks.unfinished(texts, spark.read.parquet(a.scores), ["company", "year"])
    except Exception as e:  # noqa: BLE001  nothing is there before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
    encoder, detector = _encoder(spark, a), language.opened(spark, a.language) if a.language else providers.word_detector()
    german = a.german or a.goals
    refs = {False: stages.references(spark, a.goals, a.glossary, False, encoder), True: stages.references(spark, german, a.glossary, True, encoder)}
    sinks.write_scores(stages.score_reports(texts, sentences, refs, detector, encoder), a.scores)
    return spark.read.parquet(a.scores).groupBy("company", "year").agg(F.count("*").alias("sentences"))


def counts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return reports.threshold_counts(spark.read.parquet(a.scores), a.thresholds)


def firms(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cover = reports.coverage(spark.read.parquet(a.scores), a.threshold, ["company"])
    return reports.uncovered(cover).orderBy("company") if a.zero else reports.top(cover)


def select(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = stages.requests(spark.read.parquet(a.scores), files.sentences(spark, a.texts), a.threshold, a.model)
    n = sinks.write_requests(rows, ["company", "year", "sentence_id"], a.requests, a.batch_lines)
    return spark.createDataFrame([(n,)], "files int")


def tokens(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    counter = providers.rank_file_counter(a.ranks, a.pattern) if a.ranks else providers.named_counter(a.encoding) if a.encoding else providers.piece_counter()
    rows = files.lenient_texts(spark, a.texts).select("company", "year", providers.token_count(F.col("text"), counter).alias("tokens"))
    sinks.write_tokens(rows, a.out)
    return rows.agg(F.count("*").alias("files"), F.countDistinct("company").alias("companies"), F.sum("tokens").alias("tokens"))


def _buckets(spark: SparkSession, a: argparse.Namespace) -> buckets.BucketTable:
    return buckets.BucketTable(spark, a.buckets, store.RESULTS)


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Adds the answers of response files to the results, which are a table or, with --buckets, a folder of buckets."""
    if a.buckets:
        _buckets(spark, a).append(stages.load_answers(files.responses(spark, a.outputs)))
        return _buckets(spark, a).read().groupBy("batch_id").agg(F.count("*").alias("rows"))
    store.create(spark, a.table)
    store.append(stages.load_answers(files.responses(spark, a.outputs)), a.table)
    store.create_view(spark, a.table)
    return spark.table(a.table).groupBy("batch_id").agg(F.count("*").alias("rows"))


def audit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Invalid answers with reason and sentence; the table's if both sources are given. Of the reason that is most common by far, a few."""
    if not (a.from_table or a.from_batch_dir):
        raise SystemExit("give --from-table or --from-batch-dir")
    rows = spark.table(a.from_table).select("custom_id", "raw") if a.from_table else files.responses(spark, a.from_batch_dir, audit=True).select("custom_id", F.col("content").alias("raw"))
    bad = answered(rows).select("custom_id", "raw", F.coalesce("answer.reason", F.when(F.col("raw").isNull(), F.lit(UNREADABLE))).alias("reason")).where("reason IS NOT NULL")
    parts = bad.withColumn("p", custom_id_parts(F.col("custom_id"))).select("reason", "custom_id", "raw", F.col("p.sentence_id").try_cast("int").alias("sentence_id"), "p.company", F.col("p.year").try_cast("int").alias("year"))
    if a.texts:
        parts = reports.with_sentence(parts, files.sentences(spark, a.texts), ["company", "year", "sentence_id"])
    return sampling.sample_of(parts, "reason", ZERO_WITH, "custom_id", a.limit_first, a.seed)


def repair(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Puts repaired answers in place; in buckets, only those that hold one are written."""
    if a.buckets:
        made = _buckets(spark, a)
        since, fixes = made.version(), cut(stages.repairs(made.read()))
        made.update(fixes)
        return spark.createDataFrame([(fixes.count(), len(made.changed(since)))], "repaired long, buckets int")
    seen = Observation("repair")
    store.replace(stages.repaired(spark.table(a.table), seen), a.table)
    return spark.createDataFrame([(seen.get["changed"],)], "repaired long")


def sample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Copies some report folders, and lists them."""
    units = files.folders(spark, a.texts).withColumn("key", F.concat_ws("/", "company", "year"))
    rows = []
    for r in sampling.sample(units, "key", a.n, a.seed).collect():  # at most n
        done = [p if sinks.copy_if_exists(spark, f"{a.texts}/{r.key}/{name}", p, a.overwrite) else "" for name in ("results.txt", "splits.json") for p in [f"{a.target}/{r.key}/{name}"]]
        rows.append((f"{a.texts}/{r.key}", *done))
    listed = spark.createDataFrame(rows, "source_dir string, dest_results string, dest_splits string")
    sinks.write_manifest(listed, f"{a.target}/sample_manifest.tsv")
    print("{folders} folders, {incomplete} lack a file".format(**sampling.incomplete(listed).first().asDict()))
    return listed


def examples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Up to two sentences of each report with a low or a high score, and the reference that is best for each."""
    refs = stages.references(spark, a.goals, a.glossary, False, _encoder(spark, a))
    keys = [r.ref_key for r in refs.orderBy("ord").select("ref_key").collect()]  # a dictionary
    rows = spark.read.parquet(a.scores).where(~F.col("german")).join(files.sentences(spark, a.texts).select("company", "year", "sentence_id", F.col("sentence").alias("text")), ["company", "year", "sentence_id"])
    return reports.example_lines(reports.examples(rows, keys, ["company", "year"], a.low, a.high), ["company", "year"]).orderBy("company", "year", "rank").select("line")


def glossary(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The glossary's pairs whose name is as alike as the threshold to a query, also written as one JSON document."""
    encoder = providers.hashing_encoder()
    names = files.dictionary(spark, a.glossary).withColumn("vec", providers.embedded(F.col("key"), encoder))
    asked = spark.createDataFrame([(a.query,)], "q string").select(providers.embedded(F.col("q"), encoder).alias("q"))
    found = references.glossary(names, asked, a.threshold).select("key", "value", "similarity").orderBy("key")
    sinks.write_object(found.select("key", "value"), a.out)
    return found


def _client(a: argparse.Namespace) -> providers.BatchClient:
    module, _, factory = a.client.partition(":")
    return getattr(importlib.import_module(module), factory)()


def submit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Submits request files that the log doesn't name yet, and logs their jobs."""
    return spark.createDataFrame(jobs.submitted(spark, a.requests, _client(a), a.log), "batch_no int, id string")


def follow(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Follows the service's jobs: keeps the history of their changes and saves outputs as they come, until it is stopped or `--seconds` are over."""
    query = job_stream.follow(spark, _client(a), a.history, a.outputs, a.checkpoint, every=a.every)
    query.awaitTermination(a.seconds) if a.seconds else query.awaitTermination()
    query.stop()
    return job_stream.latest(spark.read.parquet(a.history)).orderBy("id")


def track(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Takes up requests and response files that came since the last time; shows how many ids are in which state."""
    answers = ingest.response_stream(spark, a.outputs)
    tracking.track(tracking.asked_stream(spark, a.requests), answers, a.history, a.checkpoint).awaitTermination()
    return tracking.current(spark.read.parquet(a.history)).groupBy("status", "conflict").agg(F.count("*").alias("ids")).orderBy("status", "conflict")


def status(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Progress of the jobs that a log names, or else of those in progress on the service."""
    client = _client(a)
    if a.log:
        ids = batching.logged_ids(files.log_lines(spark, a.log)).orderBy("line_no").select("id")
    else:
        ids = batching.in_progress(jobs.job_table(spark, client)).select("id")
    return batching.status_lines(batching.status(jobs.looked_up(ids, client)))


def poll(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Saves the outputs of a log's jobs, a file each."""
    client = _client(a)
    done = jobs.looked_up(batching.logged_ids(files.log_lines(spark, a.log)).select("id"), client)
    return spark.createDataFrame(jobs.save_outputs(spark, done, client, a.outputs), "id string, lines int")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for name in positional:
            c.add_argument(name)
        return c

    c = command(score, "texts", "scores")
    c.add_argument("--goals", nargs="+", required=True)
    c.add_argument("--german", nargs="+", help="the goals' German dictionaries")
    c.add_argument("--glossary", required=True)
    c.add_argument("--language", help="a model of learn-language")
    c.add_argument("--encoder", help="a model of learn-encoder")
    command(learn_language, "table", "out")
    command(learn_encoder, "table", "out").add_argument("--dim", type=int, default=factors.DIM)
    command(import_scores, "root", "scores").add_argument("--names", nargs="+", required=True)
    command(histogram, "scores", "cube")
    c = command(coverage, "cube")
    c.add_argument("--thresholds", nargs="+", type=float, default=[0.5, 0.3])
    c.add_argument("--by", nargs="*", default=["company"])
    command(counts, "scores").add_argument("--thresholds", nargs="+", type=float, default=[0.5, 0.3])
    c = command(firms, "scores")
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--zero", action="store_true")
    c = command(select, "scores", "texts", "requests")
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--batch-lines", type=int, default=20_000)
    c.add_argument("--model", default="model-x")
    c = command(tokens, "texts", "out")
    c.add_argument("--ranks")
    c.add_argument("--encoding", help="name of an encoding or of a model")
    c.add_argument("--pattern", default=r"\S+|\s+")
    c = command(load, "outputs")
    c.add_argument("--table", default="results")
    c.add_argument("--buckets", help="folder of a table in buckets")
    c = command(audit)
    c.add_argument("--from-table")
    c.add_argument("--from-batch-dir")
    c.add_argument("--texts")
    c.add_argument("--limit-first", type=int, default=5)
    c.add_argument("--seed", type=int, default=42)
    c = command(repair)
    c.add_argument("--table", default="results")
    c.add_argument("--buckets", help="folder of a table in buckets")
    c = command(sample, "texts", "target")
    c.add_argument("--n", type=int, default=10)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--overwrite", action="store_true")
    c = command(examples, "scores", "texts")
    c.add_argument("--goals", nargs="+", required=True)
    c.add_argument("--glossary", required=True)
    c.add_argument("--encoder", help="a model of learn-encoder")
    c.add_argument("--low", type=float, default=0.3)
    c.add_argument("--high", type=float, default=0.5)
    c = command(glossary, "glossary", "query", "out")
    c.add_argument("--threshold", type=float, default=0.5)
    c = command(submit, "requests", "log")
    c.add_argument("--client", required=True, help="module:factory of a BatchClient")
    c = command(status)
    c.add_argument("--log")
    c.add_argument("--client", required=True)
    c = command(follow, "history", "outputs", "checkpoint")
    c.add_argument("--client", required=True)
    c.add_argument("--every", default="60 seconds")
    c.add_argument("--seconds", type=int)
    command(track, "requests", "outputs", "history", "checkpoint")
    c = command(poll, "log", "outputs")
    c.add_argument("--client", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lumenry {args.command}").getOrCreate()
    args.run(spark, args).show(1000, truncate=False)


if __name__ == "__main__":
    main()
