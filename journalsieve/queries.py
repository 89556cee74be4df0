"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from journalsieve import workspace
from journalsieve.config import AnalysisConfig
from journalsieve.functions.accounts import is_pnl
from journalsieve.functions.dates import month_label, whole_days
from journalsieve.functions.text import clean_nulls
from journalsieve.operators import (
    amounts, duplicates, isolation, prepare, series, similarity_join, stats, text_match, text_vectors,
    vendor_clusters,
)
from journalsieve.operators.context import Context
from journalsieve.operators.groups import rows_in_small_groups
from journalsieve.operators.parts import Lookup, Part, Predicate, counted_amounts
from journalsieve.plans import charts, feedback, flags, history, report, validation
from journalsieve.plans.analysis import Analysis
from journalsieve.plans.registry import FLAG_NAMES, TESTS, FlagTest
from journalsieve.session import with_plan_settings
from journalsieve.sources import run_store
from journalsieve.sources.journal_csv import map_columns, read_journal_csv
from journalsieve.sources.order_journal import order_export, order_labels
from journalsieve.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EARLIER = "2001-01-01"
REVIEWED_AT = "2001-09-01T08:00:00"

_runs: dict[tuple, Analysis] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = _in_session(fn)
        return fn
    return register


def _in_session(fn: Query) -> Query:
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(with_plan_settings(spark), sf_dir)
    return run


def raw_journal(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    return map_columns(clean_nulls(order_export(spark, sf_dir, before)))


def shared_run(spark: SparkSession, sf_dir: str, before: str | None = None) -> Analysis:
    """The run of this session over ``sf_dir``: its prepared and scored journals are written once
    and read by every query that starts from them."""
    key = (spark.sparkContext.applicationId, sf_dir, before)
    if key not in _runs:
        _runs[key] = Analysis(raw_journal(spark, sf_dir, before))
    return _runs[key]


def journal_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_run(spark, sf_dir).journal


def scored_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_run(spark, sf_dir).scored


def typed_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed columns as a lazy plan straight from the export, nothing written."""
    return prepare.with_typed_columns(
        prepare.with_canonical_columns(raw_journal(spark, sf_dir)))


def context_of(spark: SparkSession, sf_dir: str, **config) -> Context:
    return Context(journal_of(spark, sf_dir), AnalysisConfig(**config))


def labelled_context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(journal_of(spark, sf_dir), labels=order_labels(spark, sf_dir))


# --- sources and sinks -----------------------------------------------------------------------


@query("read_journal_csv")
def read_journal_csv_pipe(spark, sf_dir):
    """Pipe-separated files whose lines, headers included, end with stray semicolons."""
    folder = workspace.new_folder(spark, "pipe_export")
    stray = F.concat("Mandant", F.lit(";;;")).alias("Mandant;;;")
    order_export(spark, sf_dir).select("*", stray).drop("Mandant").write.option(
        "sep", "|").option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return _as_read(read_journal_csv(spark, folder))


@query("read_journal_csv_semicolon")
def read_journal_csv_semicolon(spark, sf_dir):
    folder = workspace.new_folder(spark, "semicolon_export")
    order_export(spark, sf_dir).write.option("sep", ";").option("header", True).option(
        "ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return _as_read(read_journal_csv(spark, folder))


@query("journal_row_numbers")
def journal_row_numbers(spark, sf_dir):
    """An export in several files without a key of its own: rows are numbered as the files have them."""
    folder = workspace.new_folder(spark, "unnumbered_export")
    ordered = order_export(spark, sf_dir).repartitionByRange(16, "row_id").sortWithinPartitions("row_id")
    ordered.drop("row_id").write.option("sep", ";").option("header", True).option(
        "ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return _as_read(read_journal_csv(spark, folder))


def _as_read(journal: DataFrame) -> DataFrame:
    return journal.select(
        F.col("row_id").cast("long").alias("row_id"), "datum", "betrag", "konto_soll",
        "buchungstext", "belegnummer", "kreditor", "generalumgekehrt", "soll_haben", "mandant")


@query("clean_nulls")
def clean_null_literals(spark, sf_dir):
    return clean_nulls(order_export(spark, sf_dir)).select("row_id", "Kreditor")


@query("prepared_parquet")
def prepared_parquet(spark, sf_dir):
    journal = workspace.settle(Analysis(raw_journal(spark, sf_dir)).prepared, "prepared")
    return journal.select(
        "row_id", "_betrag", "_abs", F.date_format("_datum", "yyyy-MM-dd").alias("datum"),
        "_kontoklasse", "_is_storno", "_beleg_id", "_betrag_signed", "konto_soll", "konto_haben",
        "_konto_haben_inferred", "kreditor", "buchungstext")


@query("flags_parquet")
def flags_parquet(spark, sf_dir):
    run = Analysis.of_prepared(journal_of(spark, sf_dir))
    return workspace.settle(
        run.score().select("row_id", *[t.column for t in TESTS], "_score"), "flags")


@query("export_csv")
def export_csv(spark, sf_dir):
    folder = workspace.new_folder(spark, "export")
    rows = shared_run(spark, sf_dir).export()
    run_store.export_csv(rows, folder)
    back = spark.read.option("sep", ";").option("header", True).schema(rows.schema).csv(folder)
    return back.select("row_id", "datum", "konto_soll", "betrag", "belegnummer", "anomaly_score",
                       "anomaly_flags")


def _stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run per client and month of the scored journal."""
    scored = scored_of(spark, sf_dir).withColumn("upload", month_label(F.col("_ym")))
    found = F.count_if(report.suspicious(AnalysisConfig()))
    runs = scored.groupBy("mandant", "upload").agg(
        F.count(F.lit(1)).alias("total_rows"), found.alias("suspicious"),
        F.round(found / F.count(F.lit(1)) * 100, 2).alias("suspicious_pct")
    ).select(
        F.concat(F.lit("journal_"), "upload", F.lit(".csv")).alias("file"),
        F.concat("upload", F.lit("-28T00:00:00")).alias("run_date"),
        "total_rows", "suspicious", "suspicious_pct", "mandant")
    folder = workspace.new_folder(spark, "runs")
    run_store.append(runs, folder)
    return run_store.load(spark, folder, runs.schema)


@query("store_result")
def store_result(spark, sf_dir):
    return _stored_runs(spark, sf_dir)


@query("list_runs")
def list_runs(spark, sf_dir):
    return run_store.list_runs(_stored_runs(spark, sf_dir), "10")


@query("latest_run")
def latest_run(spark, sf_dir):
    return run_store.latest_run(_stored_runs(spark, sf_dir))


@query("retain_last_n")
def retain_last_n(spark, sf_dir):
    """The stored runs in two halves through a versioned store that removes what is not kept."""
    runs = _stored_runs(spark, sf_dir)
    store, schema = workspace.new_folder(spark, "kept-runs"), runs.schema
    half = F.pmod(F.xxhash64("mandant", "run_date", "file"), F.lit(2))
    for part in (0, 1):
        run_store.add_runs(runs.filter(half == part), store, schema)
    return run_store.load_current(spark, store, schema)


@query("gt_lookup")
def gt_lookup(spark, sf_dir):
    journal = journal_of(spark, sf_dir)
    return text_match.with_labels(journal, order_labels(spark, sf_dir), "Bezeichnung").select(
        "row_id", "gt_bezeichnung")


def _taken_in(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """One upload folder per client; each arrives and is analysed on its own."""
    root = workspace.new_folder(spark, "intake")
    export = order_export(spark, sf_dir)
    for upload in ("10", "11", "12"):
        export.filter(F.col("Mandant") == upload).write.option("sep", ";").option(
            "header", True).csv(f"{root}/inbox/upload_{upload}")
    intake.intake_stream(spark, f"{root}/inbox", f"{root}/results", f"{root}/state",
                         export.columns)
    return intake.intake_results(spark, f"{root}/results", part).drop("batch")


@query("intake_stream")
def intake_stream(spark, sf_dir):
    return _taken_in(spark, sf_dir, "totals")


@query("intake_suspicious")
def intake_suspicious(spark, sf_dir):
    """The suspicious rows stored with every upload."""
    return _taken_in(spark, sf_dir, "suspicious").withColumn("row_id", F.col("row_id").cast("long"))


@query("intake_months")
def intake_months(spark, sf_dir):
    """The monthly sums per account stored with every upload."""
    return _taken_in(spark, sf_dir, "months").select("upload", "mandant", "konto_soll", "monat", "summe")


# --- scalar functions ------------------------------------------------------------------------


@query("parse_amount")
def parse_amount(spark, sf_dir):
    return typed_journal(spark, sf_dir).select("row_id", "_betrag", "_abs")


@query("parse_date")
def parse_date(spark, sf_dir):
    return typed_journal(spark, sf_dir).select(
        "row_id", F.date_format("_datum", "yyyy-MM-dd").alias("datum"), "_ym")


@query("account_class")
def account_class(spark, sf_dir):
    return typed_journal(spark, sf_dir).select("row_id", "konto_soll", "_kontoklasse")


@query("is_reversal")
def is_reversal(spark, sf_dir):
    return typed_journal(spark, sf_dir).select("row_id", "_is_storno")


@query("voucher_id")
def voucher_id(spark, sf_dir):
    return prepare.prepare(raw_journal(spark, sf_dir)).select("row_id", "_beleg_id")


@query("signed_amount")
def signed_amount(spark, sf_dir):
    return typed_journal(spark, sf_dir).select("row_id", "_betrag_signed")


@query("mandant_detect")
def mandant_detect(spark, sf_dir):
    return history.detect_mandant(journal_of(spark, sf_dir), "export_4711.csv")


@query("derive_dims")
def derive_dims(spark, sf_dir):
    return charts.derive_dims(scored_of(spark, sf_dir)).select(
        "row_id", "Wochentag", "Monat", "Quartal", "Kalenderwoche", "Risiko-Kategorie",
        "Betrags-Klasse", "Anzahl_Flags")


# --- joins and self-relations ----------------------------------------------------------------


@query("counterpart_account")
def counterpart_account(spark, sf_dir):
    return prepare.counterpart_accounts(journal_of(spark, sf_dir))


@query("join_account_stats")
def join_account_stats(spark, sf_dir):
    context = context_of(spark, sf_dir)
    limits = amounts.account_limits(context.account_months, 3.0, 5)
    return context.journal.select("row_id", "konto_soll").join(limits, "konto_soll", "left").select(
        "row_id", "konto_count", F.round("upper_limit", 2).alias("upper_limit"),
        F.round("lower_limit", 2).alias("lower_limit"))


@query("join_group_nunique")
def join_group_nunique(spark, sf_dir):
    rows = journal_of(spark, sf_dir).filter("belegnummer != '' and not _is_storno")
    keys = ["belegnummer", "konto_soll", "_betrag"]
    counts = workspace.settle(duplicates.voucher_counts(rows, keys), "voucher_counts")
    return rows.join(counts, keys).select("row_id", "n_vouchers", "n_months")


@query("anti_regular")
def anti_regular(spark, sf_dir):
    rows = journal_of(spark, sf_dir).filter(
        counted_amounts() & (F.col("_kreditor_canonical") != ""))
    keys = ["_abs", "konto_soll", "_kreditor_canonical"]
    regular = workspace.settle(
        duplicates.regular_groups(rows, keys, 6).select(*keys), "regular")
    return rows.join(regular, keys, "left_anti").select("row_id")


@query("semi_outlier_months")
def semi_outlier_months(spark, sf_dir):
    context = context_of(spark, sf_dir)
    months = series.outlier_months(context).select("konto_soll", "_ym")
    rows = context.journal.filter(counted_amounts() & is_pnl(F.col("_kontoklasse")))
    return rows.join(months, ["konto_soll", "_ym"], "left_semi").select(
        "row_id", "konto_soll", month_label(F.col("_ym")).alias("monat"))


@query("canonical_vendor_join")
def canonical_vendor_join(spark, sf_dir):
    journal = journal_of(spark, sf_dir)
    names = workspace.settle(
        vendor_clusters.vendor_clusters(_vendor_names(journal), 0.20), "vendors")
    return prepare.canonical_vendors(journal, names).select("row_id", "_kreditor_canonical")


@query("consecutive_pair")
def consecutive_pair(spark, sf_dir):
    """Neighbours by date inside small groups of equal vendor and amount."""
    keys = ["_kreditor_canonical", "_abs"]
    rows = journal_of(spark, sf_dir).filter(
        counted_amounts() & (F.col("_kreditor_canonical") != "") & F.col("_datum").isNotNull())
    small = rows_in_small_groups(rows.select("row_id", *keys, "_datum"), keys, 20)
    order = duplicates.Window.partitionBy(*keys).orderBy("_datum", "row_id")
    return small.select(
        "row_id", F.lag("row_id").over(order).alias("previous_id"),
        whole_days(F.lag("_datum").over(order), F.col("_datum")).cast("long").alias("gap_days")
    ).filter("previous_id is not null")


# --- the tests -------------------------------------------------------------------------------


def _single(name: str, **config) -> Query:
    def run(spark, sf_dir):
        return flags.run_single_test(context_of(spark, sf_dir, **config), name)
    return run


for _name in FLAG_NAMES[:13]:
    QUERIES[_name.lower()] = _in_session(_single(_name))


@query("isolation_anomalie")
def isolation_anomalie(spark, sf_dir):
    context = context_of(spark, sf_dir, isolation_enabled=True)
    return flags.run_single_test(context, "ISOLATION_ANOMALIE")


@query("text_konto_match")
def text_konto_match_rows(spark, sf_dir):
    return flags.run_single_test(labelled_context(spark, sf_dir), "TEXT_KONTO_MATCH")


# --- aggregation, statistics, scoring --------------------------------------------------------


@query("global_stats")
def global_stats(spark, sf_dir):
    counted = journal_of(spark, sf_dir).filter(counted_amounts())
    table = stats.global_stats(counted, 3.0)
    return table.select("n_vals", *[F.round(c, 4).alias(c)
                                    for c in ("b_mean", "b_std", "b_iqr", "b_fence")])


@query("regular_patterns")
def regular_patterns(spark, sf_dir):
    rows = journal_of(spark, sf_dir).filter(
        counted_amounts() & (F.col("_kreditor_canonical") != ""))
    return duplicates.regular_groups(rows, ["_abs", "konto_soll", "_kreditor_canonical"], 6)


@query("score")
def score(spark, sf_dir):
    """All tests and the score from the prepared journal, evaluated afresh."""
    return Analysis.of_prepared(journal_of(spark, sf_dir)).score().select("row_id", "_score")


@query("custom_weight_score")
def custom_weight_score(spark, sf_dir):
    custom = {"STORNO": 3.25, "RECHNUNGSDATUM_PERIODE": 0.5}
    flagged = scored_of(spark, sf_dir).drop("_score")
    return flags.with_score(flagged, custom).select("row_id", "_score")


@query("flag_counts")
def flag_counts(spark, sf_dir):
    return report.flag_counts(scored_of(spark, sf_dir))


@query("suspicious_rows")
def suspicious_rows(spark, sf_dir):
    return shared_run(spark, sf_dir).suspicious_rows().select("row_id", "_score")


@query("flag_string")
def flag_string(spark, sf_dir):
    return scored_of(spark, sf_dir).select("row_id", report.flag_string().alias("anomaly_flags"))


@query("export_projection")
def export_projection(spark, sf_dir):
    return shared_run(spark, sf_dir).export()


@query("run_statistics")
def run_statistics(spark, sf_dir):
    return shared_run(spark, sf_dir).statistics()


@query("enabled_tests")
def enabled_tests(spark, sf_dir):
    run = Analysis.of_prepared(journal_of(spark, sf_dir))
    return report.flag_counts(run.score({"BETRAG_ZSCORE", "STORNO", "NEAR_DUPLICATE"}))


@query("run_single_test")
def run_single_test(spark, sf_dir):
    run = Analysis.of_prepared(journal_of(spark, sf_dir))
    return run.single_test("KONTO_BETRAG_ANOMALIE").select(
        "row_id", F.lit("KONTO_BETRAG_ANOMALIE").alias("test_name"))


@query("merge_flags")
def merge_flags(spark, sf_dir):
    context = context_of(spark, sf_dir)
    names = ["STORNO", "NEUER_KREDITOR_HOCH", "BELEG_KREDITOR_DUPLIKAT"]
    found = {n: flags.run_single_test(context, n) for n in names}
    merged = flags.with_score(flags.merge_flags(context.journal, found))
    return merged.select("row_id", *[f"flag_{n}" for n in names], "_score")


def _weekend(ctx: Context) -> list[Part]:
    return [Predicate((F.weekday("_datum") >= 5) & counted_amounts())]


def _busy_day(ctx: Context) -> list[Part]:
    day = ctx.journal.filter("_datum is not null").groupBy("konto_soll", "_datum").agg(F.count(F.lit(1)).alias("on_day"))
    return [Lookup(day.filter("on_day >= 3"), ["konto_soll", "_datum"], F.col("on_day").isNotNull())]


OWN_TESTS = (FlagTest("WOCHENENDE", 1.25, False, _weekend, ("datum", "betrag")),
             FlagTest("TAGESHAEUFUNG", 2.0, True, _busy_day, ("konto_soll", "datum")))


@query("own_tests")
def own_tests(spark, sf_dir):
    """The export of a run with two tests beside the registered ones."""
    run = Analysis.of_prepared(journal_of(spark, sf_dir), tests=[*TESTS, *OWN_TESTS])
    return run.export().select("row_id", "anomaly_score", "anomaly_flags")


@query("full_analysis")
def full_analysis(spark, sf_dir):
    """The whole way from the raw export to the suspicious rows, nothing shared."""
    return Analysis(raw_journal(spark, sf_dir)).export()


@query("full_analysis_text")
def full_analysis_text(spark, sf_dir):
    """The whole way with canonical vendors, similarity of texts and account labels."""
    return Analysis(raw_journal(spark, sf_dir), labels=order_labels(spark, sf_dir),
                    text_similarity=True).export()


@query("column_profile")
def column_profile(spark, sf_dir):
    return validation.column_profile(raw_journal(spark, sf_dir))


@query("test_readiness")
def test_readiness(spark, sf_dir):
    return validation.test_readiness(validation.column_profile(raw_journal(spark, sf_dir)))


@query("validation_warnings")
def validation_warnings(spark, sf_dir):
    return validation.validation_warnings(validation.column_profile(raw_journal(spark, sf_dir)))


@query("monthly_account_sums")
def monthly_account_sums(spark, sf_dir):
    return history.monthly_account_sums(context_of(spark, sf_dir).account_months)


def _save(runs: list[tuple[Analysis, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Store runs (run, file, date) of one client, the newest last; the stored records and monthly
    sums, read back."""
    spark = runs[-1][0].journal.sparkSession
    folders = [workspace.new_folder(spark, part) for part in ("history", "history-months")]
    mandant = history.detect_mandant(runs[-1][0].journal, runs[-1][1])
    for run, file, run_date in runs:
        months = history.monthly_account_sums(run.context.account_months)
        tables = (history.run_record(mandant, file, run_date, run.statistics(), run.flag_counts()),
                  history.monthly_records(mandant, file, run_date, months))
        for rows, folder in zip(tables, folders):
            run_store.append(rows, folder)
    return tuple(run_store.load(spark, folder, rows.schema) for rows, folder in zip(tables, folders))


@query("save_run")
def save_run(spark, sf_dir):
    records, _ = _save([(shared_run(spark, sf_dir), "journal.csv", "2001-09-01T00:00:00")])
    return records.select("mandant", "run_date", "file", "total_rows", "suspicious_pct",
                          F.explode("flag_counts").alias("flag", "n"))


@query("save_run_months")
def save_run_months(spark, sf_dir):
    """The monthly sums per account stored with the run."""
    return _save([(shared_run(spark, sf_dir), "journal.csv", "2001-09-01T00:00:00")])[1]


@query("last_run")
def last_run(spark, sf_dir):
    return history.previous_run(_stored_runs(spark, sf_dir))


@query("compare_runs")
def compare_runs(spark, sf_dir):
    """The journal up to a date and the whole journal, stored one after the other and compared from
    the store alone."""
    stored = _save([(shared_run(spark, sf_dir, EARLIER), "journal.csv", "2001-01-01T00:00:00"),
                    (shared_run(spark, sf_dir), "journal.csv", "2001-09-01T00:00:00")])
    return history.compare_runs(*stored).drop("mandant")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored row with a rating; one row in ten is left unrated."""
    five = F.col("row_id") % 5
    rating = (
        F.when(F.col("row_id") % 10 == 9, "").when(five < 2, "TP ").when(five < 4, "fp")
        .otherwise("unsure"))
    return report.export_projection(shared_run(spark, sf_dir).scored_once()).withColumns({
        "bewertung": rating, "mandant": F.concat(F.lit("1"), (F.col("row_id") % 3).cast("string"))})


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings saved as label records and read back."""
    folder = workspace.new_folder(spark, "labels")
    rows = feedback.labelled_rows(_reviewed(spark, sf_dir), "QS", REVIEWED_AT, REVIEWED_AT)
    run_store.append(rows, folder, "json")
    return run_store.load(spark, folder, feedback.LABEL_SCHEMA, "json")


@query("feedback_save")
def feedback_save(spark, sf_dir):
    return _labels(spark, sf_dir).select(
        "mandant", "row_index", "belegnummer", "anomaly_score", "anomaly_flags", "label", "pruefer",
        "labeled_at")


@query("label_counts")
def label_counts(spark, sf_dir):
    return feedback.label_counts(_labels(spark, sf_dir))


@query("feedback_stats")
def feedback_stats(spark, sf_dir):
    return feedback.feedback_stats(_labels(spark, sf_dir))


@query("reweight")
def reweight(spark, sf_dir):
    return feedback.reweight(_labels(spark, sf_dir))


@query("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    context = labelled_context(spark, sf_dir)
    combos = text_match.text_label_counts(context)
    return text_match.threshold_sweep(text_match.rows_with_cosine(context, combos), combos)


@query("similarity_percentiles")
def similarity_percentiles(spark, sf_dir):
    combos = text_match.text_label_counts(labelled_context(spark, sf_dir))
    return text_match.similarity_percentiles(combos).select(
        "measure", F.round("value", 5).alias("value"), "n_below")


# --- vectors and entity resolution -----------------------------------------------------------


@query("text_vectors")
def text_vectors_of_turns(spark, sf_dir):
    """Vectors of whole conversation turns, keyed by turn."""
    turns = workspace.spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "text").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return text_vectors.text_vectors(turns, "text", "turn_id").select(
        F.col("text").alias("turn_id"), "gram", F.round("weight", 6).alias("weight"))


@query("cosine_pairs")
def cosine_pairs(spark, sf_dir):
    """Each embedding paired with the next one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids = vectors.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    return text_vectors.cosine_pairs(ids, vectors, "vec_id", "embedding").select(
        "id_a", "id_b", F.round("cosine", 6).alias("cosine"))


def _vendor_names(journal: DataFrame) -> DataFrame:
    return journal.filter("kreditor != ''").groupBy("kreditor").agg(
        F.min("row_id").alias("first_row"))


@query("vendor_clusters")
def vendor_cluster_map(spark, sf_dir):
    return vendor_clusters.vendor_clusters(_vendor_names(journal_of(spark, sf_dir)), 0.20)


@query("near_duplicate_similar_texts")
def near_duplicate_similar_texts(spark, sf_dir):
    """Near duplicates with text vectors instead of equal texts."""
    journal = journal_of(spark, sf_dir)
    vectors = workspace.settle(
        text_vectors.text_vectors(journal, "buchungstext").select("text", "gram", "weight"),
        "posting_vectors")
    return flags.run_single_test(Context(journal, vectors=vectors), "NEAR_DUPLICATE")


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    """Clusters of given dense vectors; the names are the ids."""
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("kreditor"), F.col("vec_id").alias("first_row"),
        F.col("embedding").alias("vector"))
    vectors = similarity_join.unit_vectors(given, "kreditor")
    return vendor_clusters.vendor_clusters(given, 0.58, vectors)


def _given_vectors(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """(text, vector): every text takes the embedding that its digest points to."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    digest = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    count = embeddings.agg(F.count(F.lit(1))).scalar()
    return texts.distinct().withColumn("vec_id", digest % count).join(embeddings, "vec_id").select("text", "vector")


@query("near_duplicate_given_vectors")
def near_duplicate_given_vectors(spark, sf_dir):
    """Near duplicates whose texts are alike by given dense vectors."""
    journal = journal_of(spark, sf_dir)
    texts = journal.select(F.col("buchungstext").alias("text"))
    vectors = workspace.settle(similarity_join.unit_vectors(_given_vectors(spark, sf_dir, texts)), "given_vectors")
    config = AnalysisConfig(near_duplicate_text_similarity=0.1)
    return flags.run_single_test(Context(journal, config, vectors), "NEAR_DUPLICATE")


# --- chart data ------------------------------------------------------------------------------


@query("score_histogram")
def score_histogram(spark, sf_dir):
    return charts.score_histogram(scored_of(spark, sf_dir))


@query("flag_frequency")
def flag_frequency(spark, sf_dir):
    return charts.flag_frequency(report.flag_counts(scored_of(spark, sf_dir)))


@query("monthly_pnl")
def monthly_pnl(spark, sf_dir):
    return charts.monthly_pnl(journal_of(spark, sf_dir))


@query("top_accounts")
def top_accounts(spark, sf_dir):
    return charts.top_accounts(scored_of(spark, sf_dir))


@query("income_expense_monthly")
def income_expense_monthly(spark, sf_dir):
    return charts.income_expense_monthly(journal_of(spark, sf_dir))


@query("volume_heatmap")
def volume_heatmap(spark, sf_dir):
    return charts.volume_heatmap(journal_of(spark, sf_dir))


@query("amount_vs_score")
def amount_vs_score(spark, sf_dir):
    return charts.amount_vs_score(scored_of(spark, sf_dir))


@query("vendor_treemap")
def vendor_treemap(spark, sf_dir):
    return charts.vendor_treemap(scored_of(spark, sf_dir))


@query("account_timeline")
def account_timeline(spark, sf_dir):
    return charts.account_timeline(scored_of(spark, sf_dir))


@query("debit_credit_balance")
def debit_credit_balance(spark, sf_dir):
    return charts.debit_credit_balance(journal_of(spark, sf_dir))


@query("landscape_3d")
def landscape_3d(spark, sf_dir):
    return charts.landscape_3d(scored_of(spark, sf_dir))


@query("downsample")
def downsample(spark, sf_dir):
    """Nine tenths of the journal: all scored rows, the rest filled up by hash order."""
    scored = scored_of(spark, sf_dir)
    limit = int(scored.count() * 0.9)
    return charts.downsample(scored, limit).select("row_id")


@query("column_null_share")
def column_null_share(spark, sf_dir):
    raw = raw_journal(spark, sf_dir)
    return validation.column_null_share(
        raw, ["kreditor", "buchungstext", "generalumgekehrt", "soll_haben"])
