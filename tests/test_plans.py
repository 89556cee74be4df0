"""Scoring, reporting, validation, history, feedback and chart data."""

import math

import pytest
from pyspark.sql import functions as F

from journalsieve.config import AnalysisConfig
from journalsieve.operators.context import Context
from journalsieve.operators.prepare import prepare
from journalsieve.plans import charts, feedback, flags, history, report, validation
from journalsieve.plans.registry import MAX_SCORE, TESTS, WEIGHTS
from journalsieve.sources import run_store


@pytest.fixture(scope="module")
def scored_rows(spark):
    """Rows with chosen flags: (row_id, raised flag names)."""
    def make(raised):
        rows = spark.createDataFrame([(i, list(names)) for i, names in enumerate(raised)],
                                     "row_id long, raised array<string>")
        columns = {t.column: F.array_contains("raised", t.name) for t in TESTS}
        return flags.with_score(rows.withColumns(columns))
    return make


def test_registry():
    assert len(TESTS) == 15 and MAX_SCORE == 25.5
    assert [t.name for t in TESTS if t.critical] == [
        "BETRAG_ZSCORE", "KONTO_BETRAG_ANOMALIE", "NEAR_DUPLICATE", "DOPPELTE_BELEGNUMMER",
        "BELEG_KREDITOR_DUPLIKAT", "NEUER_KREDITOR_HOCH"]


def test_config_bounds():
    with pytest.raises(ValueError):
        AnalysisConfig(zscore_threshold=0.1)
    with pytest.raises(ValueError):
        AnalysisConfig(beleg_kreditor_regular_pct=0.9)
    assert AnalysisConfig(doppelte_beleg_prefix_ignore="rw, SB,").ignored_prefixes == ["RW", "SB"]


def test_suspicious_rows(scored_rows):
    scored = scored_rows([["STORNO"], ["STORNO", "LEERER_BUCHUNGSTEXT"], [], ["NEAR_DUPLICATE"],
                          ["TEXT_KONTO_MATCH"]])
    found = report.suspicious_rows(scored, AnalysisConfig()).collect()
    assert [(r.row_id, r["_score"]) for r in found] == [(1, 2.5), (3, 2.0), (4, 2.0)]
    strict = AnalysisConfig(output_threshold=3.0)
    assert [r.row_id for r in report.suspicious_rows(scored, strict).collect()] == [3]
    capped = report.suspicious_rows(scored, AnalysisConfig(max_output_rows=1)).collect()
    assert [r.row_id for r in capped] == [1]
    strings = {r.row_id: r.f for r in scored.select(
        "row_id", report.flag_string().alias("f")).collect()}
    assert strings[1] == "STORNO|LEERER_BUCHUNGSTEXT" and strings[2] == ""
    figures = report.run_statistics(scored, AnalysisConfig(max_output_rows=1)).head()
    assert (figures.total_input, figures.total_suspicious, figures.total_output) == (5, 3, 1)
    assert figures.filter_ratio == "60.0%"


def test_custom_weights(scored_rows):
    flagged = scored_rows([["STORNO", "BETRAG_IQR"]]).drop("_score")
    row = flags.with_score(flagged, {"STORNO": 0.25}).head()
    assert row["_score"] == 1.75


def journal_rows():
    rows = [{"kreditor": f"K{i % 9}", "betrag": str(100 + i * 7 % 90), "belegnummer": f"B{i // 2}",
             "datum": f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", "konto_soll": str(60000 + i % 4),
             "erfassungsdatum": f"2024-{1 + (i * 5) % 12:02d}-01"} for i in range(120)]
    rows += [{"kreditor": "Dup", "betrag": "777", "belegnummer": f"R{i}", "datum": f"2024-05-1{i}"}
             for i in range(4)]
    rows += [{"belegnummer": "S", "dvbelegnummer": "", "buchungstext": "Storno", "betrag": "5"}]
    return rows + [{"kreditor": "Neu", "betrag": "500000"}]


def test_all_at_once_equals_one_by_one(raw):
    context = Context(prepare(raw(journal_rows())))
    together = flags.with_score(flags.with_flags(context))
    found = {t.name: flags.run_single_test(context, t.name) for t in TESTS}
    apart = flags.with_score(flags.merge_flags(context.journal, found))
    columns = ["row_id", *[t.column for t in TESTS], "_score"]
    a, b = (sorted(map(tuple, d.select(*columns).collect())) for d in (together, apart))
    assert a == b and any(r[-1] > 0 for r in a)


def test_row_order_and_partitioning_do_not_matter(raw):
    rows = raw(journal_rows())
    plain = Context(prepare(rows))
    mixed = Context(prepare(rows.orderBy(F.hash("row_id")).repartition(3, "kreditor")))
    for name in ("NEAR_DUPLICATE", "BELEG_KREDITOR_DUPLIKAT", "FEHLENDE_MONATSBUCHUNG"):
        assert {r.row_id for r in flags.run_single_test(plain, name).collect()} == {
            r.row_id for r in flags.run_single_test(mixed, name).collect()}


def test_disabled_tests_stay_false(raw):
    context = Context(prepare(raw(journal_rows())))
    counts = report.flag_counts(flags.with_score(flags.with_flags(context, {"STORNO"})))
    assert {r.flag: r.n for r in counts.collect() if r.n} == {"STORNO": 1}


def test_profile_and_readiness(raw):
    rows = [{"kreditor": "A" if i == 0 else "", "belegnummer": "", "soll_haben": "S" if i < 2 else ""}
            for i in range(10)]
    profile = validation.column_profile(raw(rows))
    shares = {r.column_name: (r.fill_pct, r.status) for r in profile.collect()}
    assert shares["kreditor"] == (10.0, "sparse") and shares["betrag"] == (100.0, "ok")
    assert shares["belegnummer"] == (0.0, "empty") and shares["projekt"] == (0.0, "missing")
    ready = {r.test: (r.status, r.reason) for r in validation.test_readiness(profile).collect()}
    assert len(ready) == 15
    assert ready["DOPPELTE_BELEGNUMMER"] == ("blocked", "belegnummer leer")
    assert ready["NEUER_KREDITOR_HOCH"] == ("degraded", "kreditor (10%) dünn besetzt")
    assert ready["RECHNUNGSDATUM_PERIODE"] == (
        "degraded", "erfassungsdatum, buchungsperiode leer → eingeschränkt")
    assert ready["BETRAG_ZSCORE"] == ("ok", "")
    warned = {r.column_name for r in validation.validation_warnings(profile).collect()}
    assert warned == {"soll_haben", "konto_haben"}


def test_client_detection(raw, spark):
    def detect(values, name=None):
        rows = raw([{"mandant": v} for v in values])
        return history.detect_mandant(rows, name).head().mandant
    assert detect(["12", "12", "7", ""]) == "12"
    assert detect(["9", "12"]) == "12"
    assert detect(["", " "], "export_4711.csv") == "4711"
    assert detect([""], "journal.csv") == "unknown"


def test_compare_runs(spark):
    runs = spark.createDataFrame(
        [("m", "2024-01-01", "f", 99.0, {"A": 9}), ("m", "2024-02-01", "f", 7.5, {"A": 1, "B": 1, "C": 2}),
         ("m", "2024-02-01", "g", 5.0, {"A": 3, "B": 1}), ("first", "2024-02-01", "g", 5.0, {"A": 3})],
        "mandant string, run_date string, file string, suspicious_pct double, flag_counts map<string, long>")
    months = spark.createDataFrame(
        [("m", "2024-01-01", "f", "9"), ("m", "2024-02-01", "f", "2"), ("m", "2024-02-01", "f", "3"),
         ("m", "2024-02-01", "g", "1"), ("m", "2024-02-01", "g", "2"), ("m", "2024-02-01", "g", "2"),
         ("first", "2024-02-01", "g", "7")],
        "mandant string, run_date string, file string, konto_soll string")
    out = history.compare_runs(runs, months).collect()
    assert {r.mandant for r in out} == {"m"}  # a first run has nothing to compare with
    got = {(r.kind, r.name): r.delta for r in out}
    assert got == {("flag", "A"): 2.0, ("flag", "C"): -2.0, ("share", "suspicious_pct"): -2.5,
                   ("new account", "1"): None, ("removed account", "3"): None}


def test_run_store(spark, tmp_path):
    schema = "file string, run_date string, total_rows long, mandant string"
    folder = str(tmp_path / "runs")
    for day in range(1, 25):
        run_store.append(spark.createDataFrame(
            [(f"f{day}", f"2024-01-{day:02d}", day, "a")], schema), folder)
    run_store.append(spark.createDataFrame([("g", "2024-01-01", 1, "b")], schema), folder)
    runs = run_store.load(spark, folder, schema)
    assert [r.file for r in run_store.list_runs(runs, "a").limit(2).collect()] == ["f24", "f23"]
    assert {r.mandant: r.file for r in run_store.latest_run(runs).collect()} == {
        "a": "f24", "b": "g"}
    kept = run_store.retain_last_n(runs)
    assert kept.filter("mandant = 'a'").agg(F.min("run_date")).head()[0] == "2024-01-05"
    assert kept.count() == 21
    assert {r.mandant: r.file for r in history.previous_run(runs).collect()} == {"a": "f23"}


def _labels(spark, n, rating, flag="STORNO"):
    rows = [("t", i, "B", 1.5, flag, rating(i), "QS", "", "t", "10") for i in range(n)]
    return spark.createDataFrame(rows, feedback.LABEL_SCHEMA)


def test_feedback(spark):
    with pytest.raises(feedback.TooFewLabels):
        feedback.reweight(_labels(spark, 499, lambda i: "tp"))
    with pytest.raises(feedback.TooFewLabels):
        feedback.feedback_stats(_labels(spark, 199, lambda i: "tp"))
    stats = {r.flag: r for r in feedback.feedback_stats(
        _labels(spark, 200, lambda i: ["tp", "fp", "fp", "unsure"][i % 4], "STORNO| X ")).collect()}
    assert set(stats) == {"STORNO", "X", "GESAMT"}
    assert (stats["X"].tp, stats["X"].fp, stats["X"].unsure) == (50, 100, 50)
    assert stats["GESAMT"].precision == round(1 / 3, 6)
    halved = feedback.learned_weights(_labels(spark, 500, lambda i: "fp"))
    assert halved == {"STORNO": round(WEIGHTS["STORNO"] * 0.5, 2)}
    raised = feedback.learned_weights(_labels(spark, 500, lambda i: "tp", "STORNO|UNKNOWN"))
    assert raised == {"STORNO": 2.25}
    rare = feedback.learned_weights(_labels(spark, 500, lambda i: "tp" if i < 9 else "unsure"))
    assert rare == {}


def test_saved_labels(spark):
    rows = spark.createDataFrame(
        [(1, "B1", 2.0, "STORNO", " TP ", "10"), (2, "B2", 2.0, "STORNO", "maybe", "10"),
         (3, "B3", 2.0, "STORNO", None, "10")],
        "row_id long, belegnummer string, anomaly_score double, anomaly_flags string, "
        "bewertung string, mandant string")
    saved = feedback.labelled_rows(rows, " QS ", "2024-01-01T00:00:00").collect()
    assert [(r.row_index, r.label, r.pruefer) for r in saved] == [(1, "tp", "QS")]
    with pytest.raises(ValueError):
        feedback.labelled_rows(rows, " ", "2024-01-01T00:00:00")


def test_downsample(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 2.0).otherwise(0.0).alias("_score"))
    assert charts.downsample(rows, 2000).count() == 2000
    sample = charts.downsample(rows, 500)
    assert sample.count() == 500 and sample.filter("_score > 0").count() == 200
    assert sample.distinct().count() == 500
    assert sorted(sample.collect()) == sorted(charts.downsample(rows.repartition(5), 500).collect())


def test_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.5, 2.0, 4.0, 9.0, 100.0, 2e6)], "x double")
    risk = [r[0] for r in rows.select(charts._binned(F.col("x"), -0.01, charts.RISK_BINS)).collect()]
    assert risk == ["Unauffällig", "Niedrig", "Niedrig", "Mittel", "Hoch", "Hoch", "Hoch"]
    size = [r[0] for r in rows.select(charts._binned(F.col("x"), 0.0, charts.AMOUNT_BINS)).collect()]
    assert size == [None, "<100€", "<100€", "<100€", "<100€", "<100€", ">100k€"]


def test_histogram_of_equal_scores(spark):
    rows = spark.createDataFrame([(0.0,)] * 3, "_score double")
    assert [(r.bin, r.n) for r in charts.score_histogram(rows).collect()] == [(0, 3)]
    assert math.isclose(charts.score_histogram(rows).head().mean_score, 0.0)


def test_intake_analyses_each_upload_once(spark, raw, tmp_path):
    from journalsieve.streaming import intake
    rows = raw(journal_rows()).drop("row_id")
    inbox, results, state = (str(tmp_path / n) for n in ("inbox", "results", "state"))
    rows.coalesce(1).write.option("sep", ";").option("header", True).csv(f"{inbox}/first")
    intake.intake_stream(spark, inbox, results, state, rows.columns)
    rows.limit(30).coalesce(1).write.option("sep", ";").option("header", True).csv(f"{inbox}/second")
    intake.intake_stream(spark, inbox, results, state, rows.columns)
    intake.intake_stream(spark, inbox, results, state, rows.columns)
    got = intake.intake_results(spark, results).collect()
    assert sorted((r.upload, r.total_input) for r in got) == [
        ("first", len(journal_rows())), ("second", 30)]
    suspicious = intake.intake_results(spark, results, "suspicious").groupBy("upload").count().collect()
    assert dict(map(tuple, suspicious)) == {r.upload: r.total_suspicious for r in got if r.total_suspicious}
    assert intake.intake_results(spark, results, "flags").count() == len(journal_rows()) + 30
    records = intake.intake_results(spark, results, "history").collect()
    assert sorted((r.file, r.total_rows, len(r.flag_counts)) for r in records) == [
        ("first", len(journal_rows()), 15), ("second", 30, 15)]
    assert intake.intake_results(spark, results, "months").select("file").distinct().count() == 2


def test_intake_parses_a_batch_like_each_upload_alone(spark, raw):
    from pyspark.sql import functions as F

    from journalsieve.operators.prepare import prepare
    from journalsieve.streaming import intake

    rows = raw(journal_rows())
    arrived = rows.select("*", F.concat(F.lit("u"), F.col("row_id") % 2).alias("upload"),
                          F.current_timestamp().alias("arrived_at"))
    typed = intake.typed_batch(arrived)
    assert {"upload", "arrived_at"} <= set(typed.columns)
    for upload in ("u0", "u1"):
        own = typed.filter(F.col("upload") == upload)
        alone = prepare(rows.filter(F.concat(F.lit("u"), F.col("row_id") % 2) == upload)).drop("_beleg_id")
        assert sorted(own.select(alone.columns).collect()) == sorted(alone.collect())


def test_small_lookups_never_shuffle_the_journal(spark, raw):
    from journalsieve.plans.analysis import Analysis

    run = Analysis(raw(journal_rows()))
    plan = run.score()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row_id" in plan and "hashpartitioning(konto_soll" not in plan


def test_score_of_a_single_reader_is_not_written(spark, raw):
    from journalsieve.plans.analysis import Analysis

    run = Analysis(raw(journal_rows()))
    alone = run.scored_once().select("row_id", "_score").collect()
    assert "scored" not in run.__dict__
    assert sorted(alone) == sorted(run.scored.select("row_id", "_score").collect())
    assert run.scored_once() is run.scored


def test_downsample_fills_up_exactly_without_a_sort(spark):
    from pyspark.sql import functions as F

    from journalsieve.plans import charts

    scored = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 50 == 0).cast("double").alias("_score"))
    for limit in (101, 2500, 4999):
        out = charts.downsample(scored, limit)
        assert out.count() == limit and out.filter("_score > 0").count() == 100
        assert "TakeOrdered" not in out._jdf.queryExecution().toString()


def test_landscape_takes_plain_numbers_only(spark):
    from journalsieve.plans import charts

    rows = spark.createDataFrame([(i, k, 1.0, 0.0) for i, k in enumerate(["4711", "4711d", "NaN", "1e3"])],
                                 "row_id long, konto_soll string, _abs double, _score double")
    rows = rows.selectExpr("*", "date'2024-01-01' as _datum")
    assert [r.konto_num for r in charts.landscape_3d(rows).orderBy("row_id").collect()] == [4711.0, 1000.0]


def test_own_tests_reach_flags_score_export_and_readiness(spark, raw):
    from journalsieve.operators.parts import Lookup, Predicate, RowIds
    from journalsieve.plans.analysis import Analysis
    from journalsieve.plans.registry import FlagTest

    own = [FlagTest("FILIALE_LEER", 2.5, False, lambda ctx: [Predicate(F.col("filiale") == "")], ("filiale",), ("datum",)),
           FlagTest("ZWEIMAL", 0.5, True, lambda ctx: [
               RowIds(ctx.journal.filter("buchungstext = 'doppelt'").select("row_id")),
               Lookup(ctx.journal.groupBy("belegnummer").agg(F.count(F.lit(1)).alias("times")), ["belegnummer"],
                      (F.col("times") == 2) & (F.col("belegnummer") != ""))], ("region",))]
    rows = raw([{"filiale": "", "belegnummer": "a"}, {"filiale": "x", "belegnummer": "b"},
                {"filiale": "x", "belegnummer": "b"}, {"filiale": "x", "buchungstext": "doppelt", "belegnummer": "c"},
                {"filiale": "x", "belegnummer": "d"}])
    run = Analysis(rows, tests=[*TESTS, *own])
    found = {r.row_id: (r.anomaly_score, r.anomaly_flags) for r in run.export().collect()}
    assert found == {0: (2.5, "FILIALE_LEER"), 1: (0.5, "ZWEIMAL"), 2: (0.5, "ZWEIMAL"), 3: (0.5, "ZWEIMAL")}
    counts = {r.flag: r.n for r in run.flag_counts().collect()}
    assert list(counts)[-2:] == ["FILIALE_LEER", "ZWEIMAL"] and counts["FILIALE_LEER"] == 1 and counts["ZWEIMAL"] == 3
    assert run.statistics().head().max_possible_score == sum(t.weight for t in [*TESTS, *own])
    assert {r.row_id for r in run.single_test("ZWEIMAL").collect()} == {1, 2, 3}
    alone = Analysis(rows, AnalysisConfig(custom_weights={"ZWEIMAL": 4.0}), tests=own[1:])
    assert {r.row_id: r.anomaly_score for r in alone.export().collect()} == {1: 4.0, 2: 4.0, 3: 4.0}
    status = {r.test: r.status for r in run.readiness().collect()}
    assert status["FILIALE_LEER"] == "ok" and status["ZWEIMAL"] == "blocked" and status["LEERER_BUCHUNGSTEXT"] == "ok"
    for wrong in ([*TESTS, FlagTest("storno", 1.0, False, own[0].rule)], [], [FlagTest("a|b", 1.0, False, own[0].rule)]):
        with pytest.raises(ValueError):
            Analysis(rows, tests=wrong)


def test_retention_removes_and_readers_see_whole_versions(spark, tmp_path):
    store, schema = f"{tmp_path}/store", "run_date string, file string, n int, mandant string"
    assert run_store.current_version(spark, store) is None
    assert run_store.load_current(spark, store, schema).count() == 0
    reader = None
    for day in range(7):
        rows = spark.createDataFrame([(f"2024-01-{day + 1:02}", f"{f}.csv", day, m) for m in ("a", "b") for f in (1, 2)
                                      if (day, m) != (6, "b")], schema)
        assert run_store.add_runs(rows, store, schema, keep=5) == day
        if day == 5:
            reader = run_store.load_current(spark, store, schema)  # made before the last change
    assert sorted({r.n for r in reader.collect()}) == [1, 2, 3, 4, 5] and reader.count() == 20
    now = run_store.load_current(spark, store, schema).collect()
    assert sorted((r.mandant, r.n) for r in now if r.file == "1.csv") == [
        *[("a", n) for n in range(2, 7)], *[("b", n) for n in range(1, 6)]]
    # files of older versions are gone; a version written but not published is not seen and written over
    held = {p.parent.parent.name for p in tmp_path.glob("store/version=*/mandant=*/*.parquet")}
    assert held == {"version=5", "version=6"}
    reader.limit(1).write.partitionBy("mandant").parquet(f"{store}/version=7")
    assert run_store.current_version(spark, store) == 6 and run_store.load_current(spark, store, schema).count() == 20
    assert run_store.add_runs(reader.limit(0), store, schema, keep=5) == 7
    assert run_store.load_current(spark, store, schema).count() == 20
