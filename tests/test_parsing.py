import pytest
from pyspark.sql import functions as F

from journalsieve import queries, workspace
from journalsieve.functions.amounts import parse_amounts
from journalsieve.functions.dates import parse_dates, whole_days
from journalsieve.functions.text import clean_nulls, strip
from journalsieve.operators.prepare import counterpart_accounts, named_month, prepare, with_counterparts
from journalsieve.sources.journal_csv import read_journal_csv, resolve_headers, sniff

AMOUNTS = {
    "1.234,56": 1234.56, "-1.234.567,8": -1234567.8, "1234,5": 1234.5, "1,234.56": 1234.56,
    "1234.56": 1234.56, "€ 99,90": 99.9, "12 345,00 €": 12345.0, " 7,00": 7.0, ",50": 0.5,
    "1e3": 1000.0, "1,234": 1234.0, "1.234": 1.234, "abc": None, "": None, "1d": None,
    "12.34,5": None, "--5": None,
    # a comma before three digits is a thousands separator, the dot stays decimal
    "1.234,567": 1.234567,
}

DATES = {
    "2024-01-15": "2024-01-15 00:00:00", "2024-1-5": "2024-01-05 00:00:00",
    "15.01.2024": "2024-01-15 00:00:00", "5.1.24": "2024-01-05 00:00:00",
    "05.01.75": "2075-01-05 00:00:00", "2024-01-15T07:24:06": "2024-01-15 07:24:06",
    "2023-12-15 07:24:06.000": "2023-12-15 07:24:06", "15.01.2024 10:11:12": "2024-01-15 10:11:12",
    "15.01.2024 10:11": "2024-01-15 10:11:00", " 15.01.2024 ": "2024-01-15 00:00:00",
    "2024-02-30": None, "2024-01-15 10:11": None, "2024-01-15.000": None, "NULL": None, "": None,
    "15.01": None, "9999-12-31": None, "15/01/2024": None, "2024-01-15x": None,
}


def test_amounts(spark):
    df = spark.createDataFrame([(k,) for k in AMOUNTS], "s string")
    got = {r.s: r.a for r in parse_amounts(df, {"a": "s"}).collect()}
    assert got == AMOUNTS


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string")
    out = parse_dates(df, {"d": "s"}).select(
        "s", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert {r.s: r.d for r in out.collect()} == DATES


def test_day_gap_counts_completed_days(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 20:00:00' a, timestamp_ntz'2024-01-03 10:00:00' b")
    assert row.select(whole_days(F.col("a"), F.col("b"))).head()[0] == 1


def test_strip_and_null_literals(spark):
    df = spark.createDataFrame([("\t x　 ", "NULL"), ("y", "None"), ("z", "ok")], "a string, b string")
    assert [r[0] for r in df.select(strip("a")).collect()] == ["x", "y", "z"]
    assert [r.b for r in clean_nulls(df).collect()] == [None, None, "ok"]


@pytest.mark.parametrize("headers, expected", [
    (["Belegdatum", "FiBuBetrag", "Kontonummer", "Buchungstext", "Bezeichnung"],
     ["datum", "betrag", "konto_soll", "buchungstext", "kreditor"]),
    (["Datum", "Betrag", "Soll/Haben"], ["datum", "betrag", "soll_haben"]),
    (["Steuerschlüssel", "Datum", "datum"], ["steuerschluessel", "Datum_source", "datum"]),
    (["Mein Lieferant", "Gesamtbetrag", "x"], ["kreditor", "betrag", "x"]),
])
def test_headers(headers, expected):
    assert resolve_headers(headers) == expected


def test_separator():
    assert sniff("a|b|c;;;") == ("|", ["a", "b", "c"])
    assert sniff("a;b;c") == (";", ["a", "b", "c"])
    assert sniff('"a,1",b,c') == (",", ["a,1", "b", "c"])
    assert sniff("a\tb\tc")[0] == "\t"
    with pytest.raises(ValueError):
        sniff("a;b")


def test_read_files(spark, tmp_path):
    pipe = tmp_path / "pipe.csv"
    pipe.write_text("﻿Belegdatum|FiBuBetrag|Kontonummer|Buchungstext;;\n"
                    "2024-01-15|1.500,00|62000|Miete;;\n", encoding="utf-8")
    row = read_journal_csv(spark, str(pipe)).head()
    assert (row.datum, row.betrag, row.konto_soll, row.buchungstext) == (
        "2024-01-15", "1.500,00", "62000", "Miete")
    semicolon = tmp_path / "semi.csv"
    semicolon.write_text("datum;betrag;kreditor\n2024-01-15;5;NULL\n2024-01-16;6;\"A;B\"\n")
    rows = read_journal_csv(spark, str(semicolon)).orderBy("datum").collect()
    assert [r.kreditor for r in rows] == [None, "A;B"]


def test_typed_columns(raw):
    rows = [
        {"konto_soll": "42.000", "betrag": "-10,00", "soll_haben": "h"},
        {"konto_soll": "62000", "betrag": "10,00", "soll_haben": "Haben"},
        {"konto_soll": "1200", "betrag": "-10,00", "soll_haben": "S"},
        {"konto_soll": "abc", "betrag": "x", "buchungstext": "Korrektur Beleg"},
        {"konto_soll": "82000", "betrag": "-5,00", "buchungstext": "Korrektur Beleg"},
        {"konto_soll": "39999", "buchungstext": "Rückbuchung"},
        {"konto_soll": "40000", "generalumgekehrt": " 1; "},
        {"konto_soll": "79999", "generalumgekehrt": "0.0;"},
    ]
    got = prepare(raw(rows)).orderBy("row_id").collect()
    assert [r["_kontoklasse"] for r in got] == [
        "Ertrag", "Aufwand", "Bestand", "Bestand", "Kostenrechnung", "Bestand", "Ertrag", "Aufwand"]
    assert [r["_betrag_signed"] for r in got][:4] == [10.0, -10.0, -10.0, 0.0]
    assert [r["_is_storno"] for r in got] == [
        False, False, False, False, True, True, True, False]


def test_voucher_switch_is_journal_wide(raw):
    without = prepare(raw([{"belegnummer": "A"}, {"belegnummer": "B", "dvbelegnummer": "NULL"}]))
    assert sorted(r["_beleg_id"] for r in without.collect()) == ["A", "B"]
    mixed = prepare(raw([{"belegnummer": "A", "dvbelegnummer": " D1 "}, {"belegnummer": "B"}]))
    assert sorted(r["_beleg_id"] for r in mixed.collect()) == ["", "D1"]


@pytest.mark.parametrize("rows, expected", [
    ([{"konto_soll": "1"}, {"konto_soll": "2", "betrag": "-100,00"}], {0: "2", 1: "1"}),
    ([{"konto_soll": "1", "konto_haben": "9"}, {"konto_soll": "2", "konto_haben": "none"}],
     {0: "9", 1: "1"}),
    ([{"konto_soll": "1"}, {"konto_soll": "2", "betrag": "100,02"}], {0: "", 1: ""}),
    ([{"konto_soll": "1"}, {"konto_soll": "2"}, {"konto_soll": "3"}], {0: "", 1: "", 2: ""}),
])
def test_counterparts(raw, rows, expected):
    journal = prepare(raw([{**r, "belegnummer": "V"} for r in rows]))
    journal = with_counterparts(journal, counterpart_accounts(journal))
    assert {r.row_id: r.konto_haben for r in journal.collect()} == expected


def test_empty_journal(raw, spark):
    from journalsieve import Analysis
    figures = Analysis(raw([{}]).limit(0)).statistics().head()
    assert (figures.total_input, figures.total_suspicious, figures.avg_score) == (0, 0, 0.0)


def test_row_ids_without_source_key(raw, spark):
    journal = prepare(raw([{}] * 5).drop("row_id"))
    assert journal.select("row_id").distinct().count() == 5


def test_quoted_pipe_export(spark, tmp_path):
    from journalsieve.sources.journal_csv import read_export

    file = tmp_path / "quoted.csv"
    file.write_text('"datum"|"konto_soll"|"buchungstext";;\n2024-01-01|62000|"a ""b"" c";;\n', encoding="utf-8")
    rows = read_export(spark, str(file)).collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", "62000", 'a "b" c')]


def test_row_numbers_follow_the_files(spark, tmp_path):
    """Equal under any split, by file path and line, for both kinds of export, blank lines left out."""
    from pyspark.sql import functions as F

    wanted = []
    for separator, end in ((";", ""), ("|", ";;")):
        folder = tmp_path / f"export{ord(separator)}"
        folder.mkdir()
        wanted = []
        for file, rows in (("b.csv", 700), ("a.csv", 30), ("c d.csv", 0), ("d.csv", 1500)):
            lines = [f"{file}-{i}{separator}{i},00{separator}62000{end}" for i in range(rows)]
            lines[10:10] = [""]
            (folder / file).write_text("\n".join([separator.join(["Buchungstext", "FiBuBetrag", "Kontonummer"]) + end, *lines]))
            wanted.append((file, rows))
        texts = [f"{file}-{i}" for file, rows in sorted(wanted) for i in range(rows)]
        before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            for size, cost in (("128m", "4m"), ("1k", "0"), ("5000b", "100b"), ("20k", "3k")):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", cost)
                rows = read_journal_csv(spark, str(folder)).orderBy(F.desc("row_id")).collect()[::-1]
                assert [r.row_id for r in rows] == list(range(len(texts)))
                assert [r.buchungstext for r in rows] == texts
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
    own = tmp_path / "own.csv"
    own.write_text("row_id;datum;betrag\n7;2024-01-01;5\n3;2024-01-02;6\n")
    assert sorted(r.row_id for r in read_journal_csv(spark, str(own)).collect()) == ["3", "7"]
    none = tmp_path / "none.csv"
    none.write_text("datum;betrag;kreditor\n")
    assert read_journal_csv(spark, str(none)).count() == 0


def test_running_totals_over_ranges(spark, monkeypatch):
    from journalsieve.operators import running

    monkeypatch.setattr(running, "PER_ROOT", 3)
    rows = [(f"k{i // 3:04d}", i % 3, i * 7 % 11) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, i int, n long").repartition(5)
    out = {(r.k, r.i): r.before for r in running.with_total_before(frame, ["k", "i"], "n", 900).collect()}
    total = 0
    for k, i, n in rows:
        assert out[k, i] == total
        total += n


def test_parts_of_a_scan_follow_its_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(workspace, "ROWS_PER_TASK", 50, raising=False)
    parts = workspace.spread(rows)
    sizes = [len(part) for part in parts.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60 and sorted(r.id for r in parts.collect()) == list(range(1000))


def test_queries_bound_the_compiled_methods(spark, monkeypatch):
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    own = queries._in_session(lambda session, folder: seen.append(session.conf.get(key)))
    spark.conf.unset(key)
    own(spark, "")
    spark.conf.set(key, "60000")  # what a session has set itself stays
    own(spark, "")
    spark.conf.set(key, "8000")
    assert seen == ["8000", "60000"]


def test_month_of_a_period_text(spark):
    texts = ["", "3/2020", "12.1998", "13/2001", "00/2001", "1.0001"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(named_month(F.col("t"))).collect()]
    assert got == [None, 2020 * 12 + 2, 1998 * 12 + 11, None, None, 12]


def test_parts_of_a_scan_follow_its_text(spark, tmp_path):
    spark.range(200).select(F.repeat(F.lit("x"), 100_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/texts")
    parts = workspace.spread(spark.read.parquet(f"{tmp_path}/texts"), "text")
    assert parts.rdd.getNumPartitions() == 20 and parts.count() == 200
    nothing = spark.read.parquet(f"{tmp_path}/texts").filter("text is null")
    assert workspace.spread(nothing, "text").count() == 0
