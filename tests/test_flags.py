"""Published scenarios of every test on hand-made journals."""

import pytest


def days(n, month=1, year=2024):
    return f"{year}-{month:02d}-{n:02d}"


@pytest.mark.parametrize("account, expected", [("42000", [99]), ("1200", []), ("82000", [])])
def test_zscore(flagged, account, expected):
    rows = [{"konto_soll": account}] * 99 + [{"konto_soll": account, "betrag": "100000,00"}]
    assert flagged("BETRAG_ZSCORE", rows) == expected


def test_zscore_leaves_out_reversals(flagged):
    rows = [{"betrag": str(100 + i % 3)} for i in range(99)]
    rows.append({"betrag": "100000", "buchungstext": "Storno Rechnung"})
    assert flagged("BETRAG_ZSCORE", rows) == []


def test_iqr_needs_fence_and_minimum(flagged):
    rows = [{"betrag": str(1000 + i)} for i in range(50)]
    assert flagged("BETRAG_IQR", rows + [{"betrag": "9999"}, {"betrag": "50000"}]) == [51]


def test_account_outlier(flagged):
    rows = [{"betrag": "1000"}] * 19 + [{"betrag": "50000"}]
    assert flagged("KONTO_BETRAG_ANOMALIE", rows) == [19]
    assert flagged("KONTO_BETRAG_ANOMALIE",
                   [{"betrag": "1000" if i % 2 else "1200"} for i in range(20)]) == []
    assert flagged("KONTO_BETRAG_ANOMALIE", rows[16:]) == []


def test_near_duplicates_on_consecutive_days(flagged):
    rows = [{"kreditor": "A", "datum": days(10 + i), "belegnummer": f"R{i}"} for i in range(4)]
    assert flagged("NEAR_DUPLICATE", rows) == [0, 1, 2, 3]
    same_day = [{**r, "datum": days(10)} for r in rows]
    assert flagged("NEAR_DUPLICATE", same_day) == []
    same_voucher = [{**r, "belegnummer": "R"} for r in rows]
    assert flagged("NEAR_DUPLICATE", same_voucher) == []


def test_near_duplicates_by_text_without_vendor(flagged):
    rows = [{"datum": days(10 + i), "belegnummer": f"R{i}", "buchungstext": t}
            for i, t in enumerate(["Miete", "Miete", "Strom"])]
    assert flagged("NEAR_DUPLICATE", rows) == [0, 1]


def test_near_duplicates_undated(flagged):
    a = {"kreditor": "A", "belegnummer": "R1"}
    b = {"kreditor": "A", "belegnummer": "R2", "datum": ""}
    assert flagged("NEAR_DUPLICATE", [a, b]) == []
    assert flagged("NEAR_DUPLICATE", [{**a, "datum": ""}, b]) == [0, 1]
    assert flagged("NEAR_DUPLICATE", [{**a, "datum": ""}, {**b, "belegnummer": "R1"}]) == []


def test_near_duplicates_skip_regular_and_large_groups(flagged):
    regular = [{"kreditor": "A", "datum": days(d, m), "belegnummer": f"{m}-{d}"}
               for m in range(1, 7) for d in (1,)] + [
        {"kreditor": "A", "datum": days(2, 1), "belegnummer": "x"}]
    assert flagged("NEAR_DUPLICATE", regular) == []
    large = [{"kreditor": "A", "datum": days(1 + i), "belegnummer": str(i)} for i in range(11)]
    assert flagged("NEAR_DUPLICATE", large) == []
    assert flagged("NEAR_DUPLICATE", large[:10]) == list(range(10))


def test_repeated_document_number(flagged):
    rows = [{"belegnummer": "B1", "dvbelegnummer": f"D{i}"} for i in range(10)]
    assert flagged("DOPPELTE_BELEGNUMMER", rows) == list(range(10))
    assert flagged("DOPPELTE_BELEGNUMMER", rows[:9]) == []
    assert flagged("DOPPELTE_BELEGNUMMER", rows, doppelte_beleg_prefix_ignore="x, b") == []


def test_debit_credit_pair_is_no_repetition(flagged):
    rows = [{"belegnummer": "B1", "dvbelegnummer": f"D{i}", "soll_haben": s}
            for i, s in enumerate("SH")]
    assert flagged("DOPPELTE_BELEGNUMMER", rows, doppelte_beleg_min_count=2) == []
    both_debit = [{**r, "soll_haben": "S"} for r in rows]
    assert flagged("DOPPELTE_BELEGNUMMER", both_debit, doppelte_beleg_min_count=2) == [0, 1]


def test_vendor_document_level1(flagged):
    rows = [{"belegnummer": "B1", "kreditor": "A", "dvbelegnummer": f"D{i}"} for i in range(4)]
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows) == [0, 1, 2, 3]
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows[:3]) == []
    regular = [{"belegnummer": f"M{m}", "kreditor": "A", "dvbelegnummer": f"X{m}",
                "datum": days(3, m)} for m in range(1, 8)]
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows + regular) == []


def test_vendor_document_level2(flagged):
    def rows(gap, vendors="AAA"):
        return [{"belegnummer": f"B{i}", "kreditor": v, "datum": days(10 + i * gap)}
                for i, v in enumerate(vendors)]
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows(1)) == [0, 1, 2]
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows(5)) == []
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows(1, "ABC")) == []
    assert flagged("BELEG_KREDITOR_DUPLIKAT", rows(1, "AA")) == []


def test_reversals(flagged):
    rows = [{"buchungstext": "Storno Rechnung 123"},
            {"buchungstext": "Storno Rechnung 123", "generalumgekehrt": "1"},
            {"generalumgekehrt": "DV-1;"}, {"generalumgekehrt": "0.0"},
            {"buchungstext": "Gutschrift"}]
    assert flagged("STORNO", rows) == [0]
    credit = [{"betrag": str(100 + i % 5)} for i in range(30)] + [
        {"buchungstext": "Gutschrift", "betrag": "99999"}]
    assert flagged("STORNO", credit) == [30]
    equal = [{"buchungstext": "Gutschrift"}] * 3
    assert flagged("STORNO", equal) == []


def test_empty_text(flagged):
    texts = ["", "Diverse", " ab ", "abc", "TODO", "Miete"]
    assert flagged("LEERER_BUCHUNGSTEXT", [{"buchungstext": t} for t in texts]) == [0, 1, 2, 4]
    assert flagged("LEERER_BUCHUNGSTEXT", [{"buchungstext": "", "konto_soll": "1200"}]) == []


def test_period_mismatch(flagged):
    rows = [{"erfassungsdatum": "2024-03-31"}, {"erfassungsdatum": "2024-04-01"},
            {"erfassungsdatum": ""}, {"erfassungsdatum": "01.05.2024", "buchungstext": "Storno"}]
    assert flagged("RECHNUNGSDATUM_PERIODE", rows) == [1]
    # the posting period is used only when no row has an entry date
    assert flagged("RECHNUNGSDATUM_PERIODE",
                   [{"buchungsperiode": "2024-09-01"}, {"buchungsperiode": "x"}]) == [0]
    assert flagged("RECHNUNGSDATUM_PERIODE",
                   [{"buchungsperiode": "2024-09-01"}, {"erfassungsdatum": "2024-01-20"}]) == []
    assert flagged("RECHNUNGSDATUM_PERIODE", [{}]) == []


def test_period_in_text(flagged):
    texts = ["Miete 01/2024", "Miete 02/2024", "Miete 13/2024", "Miete 1.2023", "Miete 2024",
             "Storno 05/2024"]
    assert flagged("BUCHUNGSTEXT_PERIODE", [{"buchungstext": t} for t in texts]) == [1, 3]


def test_new_vendor(flagged):
    rows = [{"kreditor": "Alt", "betrag": str(100 + i % 7)} for i in range(50)]
    rows += [{"kreditor": "Neu", "betrag": "90000"}, {"kreditor": "", "betrag": "90000"},
             {"kreditor": "Klein", "betrag": "5"}]
    assert flagged("NEUER_KREDITOR_HOCH", rows) == [50]
    thrice = rows[:50] + [{"kreditor": "Neu", "betrag": "90000"}] * 3
    assert flagged("NEUER_KREDITOR_HOCH", thrice) == []
    assert flagged("NEUER_KREDITOR_HOCH", thrice, new_kreditor_max_bookings=3) == [50, 51, 52]


def test_monthly_outlier(flagged):
    rows = [{"datum": days(5, m), "betrag": "1000"} for m in range(1, 12) for _ in range(3)]
    rows += [{"datum": days(5, 12), "betrag": "10000"}] * 3
    assert flagged("MONATS_ENTWICKLUNG", rows) == [33, 34, 35]
    assert flagged("MONATS_ENTWICKLUNG", [{**r, "konto_soll": "1200"} for r in rows]) == []
    assert flagged("MONATS_ENTWICKLUNG", rows[::4]) == []


def months(used):
    return [{"datum": days(5, m)} for m in used for _ in range(2)]


def test_missing_month(flagged):
    assert flagged("FEHLENDE_MONATSBUCHUNG", months([1, 2, 4, 5, 6])) == [2, 3, 4, 5]
    twelve = [m for m in range(1, 13) if m != 7]
    assert flagged("FEHLENDE_MONATSBUCHUNG", months(twelve)) == [10, 11, 12, 13]
    assert flagged("FEHLENDE_MONATSBUCHUNG", months(range(1, 13))) == []
    assert flagged("FEHLENDE_MONATSBUCHUNG", months([1, 2, 3, 5])) == []


def test_missing_month_counts_the_span_of_the_journal(flagged):
    rows = months(range(1, 13)) + [{"datum": days(5, m), "konto_soll": "70000"}
                                   for m in range(3, 10)]
    assert flagged("FEHLENDE_MONATSBUCHUNG", rows) == [24, 30]


def test_label_mismatch(flagged, spark):
    labels = spark.createDataFrame(
        [("62000", "Wartung Maschinen"), ("63000", "Miete"), ("1200", "Bank")],
        "konto_soll string, gt_bezeichnung string")
    rows = [{}] * 5 + [{"buchungstext": "Bewirtung Kunden"}] + [
        {"konto_soll": "63000", "buchungstext": "Strom"},
        {"konto_soll": "1200", "buchungstext": "Strom"}]
    assert flagged("TEXT_KONTO_MATCH", rows, labels=labels) == [5]
    assert flagged("TEXT_KONTO_MATCH", rows, labels=labels, text_konto_min_bookings=1) == [5, 6]
    assert flagged("TEXT_KONTO_MATCH", rows) == []


def test_isolation(flagged):
    rows = [{"betrag": str(1000 + i), "datum": days(1 + i % 28)} for i in range(99)]
    rows.append({"betrag": "9999999", "datum": days(31)})
    assert flagged("ISOLATION_ANOMALIE", rows) == []
    assert 99 in flagged("ISOLATION_ANOMALIE", rows, isolation_enabled=True)
    assert flagged("ISOLATION_ANOMALIE", rows[60:], isolation_enabled=True) == []


def test_similar_texts_replace_equal_texts(raw, spark):
    from journalsieve.operators.context import Context
    from journalsieve.operators.prepare import prepare
    from journalsieve.operators.text_vectors import text_vectors
    from journalsieve.plans import flags

    texts = ["Wartung Maschine Halle Nord Werk Emden", "Wartung Maschine Halle Nord Werk Emden 2", "Bewirtung"]
    rows = [{"buchungstext": t, "datum": days(10 + i), "belegnummer": f"R{i}"}
            for i, t in enumerate(texts)]
    journal = prepare(raw(rows))
    context = Context(journal, vectors=text_vectors(journal, "buchungstext"))
    ids = flags.run_single_test(context, "NEAR_DUPLICATE").collect()
    assert sorted(r.row_id for r in ids) == [0, 1]
