"""The queries in plain SQL over the given tables, for comparison with another engine.

Written from the rules, not from the Spark plans: self-joins and window counts where the plans use
map-side limits, exact quantile functions where the plans count cells.  ``_sql`` collects the named
common table expressions a query needs, in dependency order.
"""

from __future__ import annotations

import re

from journalsieve.schema import (
    CANONICAL_COLUMNS, GENERIC_TEXTS, NO_REVERSAL_REFERENCE, TEST_COLUMNS,
)

ORACLES: dict[str, str] = {}

_FLAGS = [
    "BETRAG_ZSCORE", "BETRAG_IQR", "KONTO_BETRAG_ANOMALIE", "NEAR_DUPLICATE",
    "DOPPELTE_BELEGNUMMER", "BELEG_KREDITOR_DUPLIKAT", "STORNO", "LEERER_BUCHUNGSTEXT",
    "RECHNUNGSDATUM_PERIODE", "BUCHUNGSTEXT_PERIODE", "NEUER_KREDITOR_HOCH", "MONATS_ENTWICKLUNG",
    "FEHLENDE_MONATSBUCHUNG", "ISOLATION_ANOMALIE", "TEXT_KONTO_MATCH",
]
_POINTS = [2.0, 1.5, 2.0, 2.0, 2.0, 2.5, 1.5, 1.0, 1.5, 1.0, 2.5, 1.5, 1.0, 1.5, 2.0]
_DECISIVE = ["BETRAG_ZSCORE", "KONTO_BETRAG_ANOMALIE", "NEAR_DUPLICATE", "DOPPELTE_BELEGNUMMER",
             "BELEG_KREDITOR_DUPLIKAT", "NEUER_KREDITOR_HOCH"]


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CTES: dict[str, str] = {}

_CTES["b"] = """
select o_orderkey as row_id, o_custkey as ck, o_orderdate as d, o_orderpriority as pr,
  o_totalprice as tp, o_orderkey % 29 = 0 as is_bulk,
  o_orderkey % 31 = 0 and o_orderkey % 29 <> 0 as is_partner, o_orderkey % 97 = 1 as is_big,
  o_orderkey % 37 = 0 as is_korr,
  cast(year(o_orderdate) as varchar) || '-' || cast(quarter(o_orderdate) as varchar) as yq,
  cast(floor(o_orderkey / 2) as bigint) as half
from orders where {where}"""

_CTES["j"] = """
select row_id, d, half,
  case when is_bulk then 50000 when is_partner then 75000
    when is_big then cast(round(tp * 2000) as bigint)
    else cast(floor(tp / 25000) * 2500000 + 10000 as bigint) end
    * case when is_korr then -1 else 1 end as cents,
  case when is_bulk then 61000 else 20000 + (ck * 37 % 70) * 1000 end as konto_num,
  case when is_korr then 'Korrektur Buchung' when row_id % 11 = 0 then 'Storno Rechnung'
    when row_id % 13 = 0 then 'diverse' when row_id % 17 = 0 then ''
    when row_id % 19 = 0 then 'Miete 03/1998'
    when row_id % 23 = 0 or (is_big and ck % 2 = 0) then 'Gutschrift Bonus'
    else 'Rechnung ' || pr end as buchungstext,
  case when is_bulk then 'SAMMEL-' || yq when is_partner then 'RE-' || yq
    else 'B-' || cast(half as varchar) end as belegnummer,
  case when is_partner then 'Partner ' || yq
    when is_big and ck % 4 = 0 then 'Neu ' || cast(row_id as varchar)
    when row_id % 7 = 0 then '' else 'Kreditor ' || cast(ck % 40 as varchar) end as kreditor,
  'DV-' || cast(half as varchar) as dvbelegnummer,
  case when row_id % 41 = 0 then 'DV-' || cast(half + 1 as varchar) || ';'
    when row_id % 43 = 0 then '0.0' else '' end as generalumgekehrt,
  case when row_id % 5 = 0 then '' when row_id % 2 = 0 then 'S' else 'H' end as sh,
  '1' || cast(row_id % 3 as varchar) as mandant, row_id % 9 * 20 as lag_days
from b"""

_CTES["t"] = f"""
select *, cents / 100.0::double as betrag, abs(cents) / 100.0::double as a,
  cast(konto_num as varchar) as konto, year(d) * 12 + month(d) - 1 as ym,
  case when konto_num between 40000 and 59999 then 'Ertrag'
    when konto_num between 60000 and 79999 then 'Aufwand'
    when konto_num >= 80000 then 'Kostenrechnung' else 'Bestand' end as kl,
  lower(rtrim(trim(generalumgekehrt), ';')) not in ({_quoted(NO_REVERSAL_REFERENCE)}) as has_gu,
  (lower(rtrim(trim(generalumgekehrt), ';')) not in ({_quoted(NO_REVERSAL_REFERENCE)})
    or regexp_matches(lower(buchungstext), 'storno|stornierung|r[uü]ckbuchung|gutschrift.*storn')
    or (regexp_matches(lower(buchungstext), '\\bkorrektur\\b') and cents < 0)) as st
from j"""

_CTES["p"] = """
select *, kl in ('Ertrag', 'Aufwand') as pnl, a > 0 and not st as ok,
  case when kl = 'Ertrag' and sh = 'H' or kl = 'Aufwand' and sh = 'S' then a
    when kl = 'Ertrag' and sh = 'S' or kl = 'Aufwand' and sh = 'H' then -a
    else betrag end as signed
from t"""

_CTES["counterpart"] = """
select x.row_id, y.konto as inferred_konto
from p x join p y on x.dvbelegnummer = y.dvbelegnummer and x.row_id <> y.row_id
where x.dvbelegnummer in (select dvbelegnummer from p group by 1 having count(*) = 2)
  and x.a > 0 and y.a > 0 and abs(x.a - y.a) <= 0.01"""

_CTES["cls"] = """
select kl, count(*) as n, avg(a) as mu, stddev_samp(a) as sd, quantile_cont(a, 0.25) as q1,
  quantile_cont(a, 0.75) as q3
from p where ok group by kl"""

_CTES["tot"] = """
select count(*) as n, avg(a) as mu, coalesce(stddev_samp(a), 0) as sd,
  quantile_cont(a, 0.25) as q1, quantile_cont(a, 0.75) as q3
from p where ok"""

_CTES["f_betrag_zscore"] = """
select row_id from p join cls using (kl) where ok and pnl and n >= 2 and sd > 0
  and (a - mu) / sd > 2.5"""

_CTES["f_betrag_iqr"] = """
select row_id from p join cls using (kl) where ok and pnl and n >= 4 and q3 > q1
  and a > q3 + 3.0 * (q3 - q1) and a > 10000"""

_CTES["limits"] = """
select konto, count(*) as n, avg(a) + 3.0 * coalesce(stddev_samp(a), 0) as hi,
  greatest(avg(a) - 3.0 * coalesce(stddev_samp(a), 0), 0) as lo
from p where ok and pnl group by konto having count(*) >= 5"""

_CTES["f_konto_betrag_anomalie"] = """
select row_id from p join limits using (konto) where ok and pnl and (a > hi or a < lo)"""

_CTES["nd"] = """
select *, case when kreditor <> '' then 'k' || kreditor else 't' || buchungstext end as partner
from p where ok"""

_CTES["nd_groups"] = """
select a, konto, partner from nd group by all
having count(*) between 2 and 10 and count(distinct ym) < 6"""

_CTES["nd_seq"] = """
select row_id, lag(row_id) over w as prev,
  floor((epoch(d) - epoch(lag(d) over w)) / 86400) between 1 and 3
    and dvbelegnummer <> lag(dvbelegnummer) over w as near
from nd join nd_groups using (a, konto, partner)
window w as (partition by a, konto, partner order by d, row_id)"""

_CTES["f_near_duplicate"] = """
select row_id from nd_seq where near union select prev from nd_seq where near"""

_CTES["doc_groups"] = """
select belegnummer, konto, betrag, count(distinct dvbelegnummer) as n_vouchers,
  count(distinct ym) as n_months
from p where belegnummer <> '' and not st group by all"""

_CTES["doc_pairs"] = """
select belegnummer from p where belegnummer <> '' and not st group by 1
having count(*) = 2 and count(*) filter (sh in ('S', 'H')) = 2 and count(*) filter (sh = 'S') = 1"""

_CTES["f_doppelte_belegnummer"] = """
select row_id from p join doc_groups using (belegnummer, konto, betrag)
where not st and n_vouchers >= 10 and n_months < 6
  and belegnummer not in (select belegnummer from doc_pairs)"""

_CTES["reg_limit"] = """
select greatest(6, cast(floor(count(distinct ym) * 0.15) as bigint)) as m from p"""

_CTES["vendor_docs"] = "select * from p where belegnummer <> '' and kreditor <> '' and not st"

_CTES["regular_vendor"] = """
select kreditor, a from vendor_docs group by all
having count(distinct ym) >= (select m from reg_limit)"""

_CTES["level1"] = """
select row_id from vendor_docs where (belegnummer, kreditor, a) in (
  select (belegnummer, kreditor, a) from vendor_docs group by belegnummer, kreditor, a
  having count(distinct dvbelegnummer) >= 4)
and (kreditor, a) not in (select (kreditor, a) from regular_vendor)"""

_CTES["level2_groups"] = """
select kreditor, a from vendor_docs where a > 0 group by all
having count(*) between 2 and 20 and count(distinct belegnummer) >= 3
  and count(distinct day(d)) > 1"""

_CTES["level2"] = """
select row_id, lag(row_id) over w as prev,
  floor((epoch(d) - epoch(lag(d) over w)) / 86400) between 0 and 1
    and belegnummer <> lag(belegnummer) over w
    and dvbelegnummer <> lag(dvbelegnummer) over w as near
from vendor_docs join level2_groups using (kreditor, a)
where (kreditor, a) not in (select (kreditor, a) from regular_vendor)
window w as (partition by kreditor, a order by d, row_id)"""

_CTES["f_beleg_kreditor_duplikat"] = """
select row_id from level1 union select row_id from level2 where near
union select prev from level2 where near"""

_CTES["f_storno"] = """
select row_id from p, tot where (st and not has_gu)
  or (contains(lower(buchungstext), 'gutschrift') and not contains(lower(buchungstext), 'storn')
      and sd > 0 and a > mu + sd)"""

_CTES["f_leerer_buchungstext"] = f"""
select row_id from p where pnl and (trim(buchungstext) = ''
  or lower(trim(buchungstext)) in ({_quoted(GENERIC_TEXTS)}) or length(trim(buchungstext)) <= 2)"""

_CTES["f_rechnungsdatum_periode"] = """
select row_id from p where not st
  and abs(datediff('month', d, d + to_days(cast(lag_days as integer)))) > 2"""

_CTES["f_buchungstext_periode"] = r"""
select row_id from (select *,
    try_cast(regexp_extract(buchungstext, '\b(\d{1,2})[/.](\d{4})\b', 1) as integer) as m,
    try_cast(regexp_extract(buchungstext, '\b(\d{1,2})[/.](\d{4})\b', 2) as integer) as y from p)
where m between 1 and 12 and (m <> month(d) or y <> year(d)) and not st"""

_CTES["f_neuer_kreditor_hoch"] = """
select row_id from p, tot where kreditor <> '' and not st and sd > 0 and a > mu + 1.5 * sd
  and kreditor in (select kreditor from p where not st group by 1 having count(*) <= 2)"""

_CTES["month_sums"] = "select konto, ym, sum(a) as s from p where ok and pnl group by all"

_CTES["spikes"] = """
select konto, ym from month_sums join (
  select konto, avg(s) as mu, stddev_samp(s) as sd from month_sums group by 1
  having count(*) >= 3) using (konto)
where sd > 0 and abs(s - mu) / sd > 3.0 and (select count(*) from p where ok and pnl) >= 10"""

_CTES["f_monats_entwicklung"] = """
select row_id from p where ok and pnl and (konto, ym) in (select (konto, ym) from spikes)"""

_CTES["booked"] = "select distinct konto, ym from p where not st and konto <> ''"

_CTES["span"] = """
select min(ym) as lo, max(ym) as hi, max(ym) - min(ym) + 1 as months, count(distinct ym) as used
from booked"""

_CTES["gaps"] = """
select konto, ym from booked, span
where konto in (select konto from booked group by 1
    having count(*) >= greatest(3, (select floor(months * 0.5) from span)))
  and (ym > lo and (konto, ym - 1) not in (select (konto, ym) from booked)
    or ym < hi and (konto, ym + 1) not in (select (konto, ym) from booked))
  and months >= 6 and used >= 3 and (select count(*) from p where not st) >= 10"""

_CTES["f_fehlende_monatsbuchung"] = """
select row_id from p where not st and (konto, ym) in (select (konto, ym) from gaps)"""

_CTES["scored"] = (
    "select *, " + " + ".join(f"flag_{n}::int * {w}::double" for n, w in zip(_FLAGS, _POINTS))
    + " as score, (" + " or ".join(f"flag_{n}" for n in _DECISIVE) + ") as crit from (select p.*, "
    + ", ".join(f"row_id in (select row_id from f_{n.lower()}) as flag_{n}" for n in _FLAGS[:13])
    + ", false as flag_ISOLATION_ANOMALIE, false as flag_TEXT_KONTO_MATCH from p)")

_CTES["out"] = (
    "select s.*, concat_ws('|', "
    + ", ".join(f"case when flag_{n} then '{n}' end" for n in _FLAGS)
    + ") as anomaly_flags, coalesce(inferred_konto, '') as konto_haben, "
    "score >= 2.0 or crit as susp from scored s left join counterpart using (row_id)")

_CTES["counts"] = " union all ".join(
    f"select '{n}' as flag, count(*) filter (flag_{n}) as n from scored" for n in _FLAGS)

_CTES["runs"] = """
select 'journal_' || strftime(d, '%Y-%m') || '.csv' as file,
  strftime(d, '%Y-%m') || '-28T00:00:00' as run_date, count(*) as total_rows,
  count(*) filter (susp) as suspicious,
  round(count(*) filter (susp) / count(*) * 100, 2) as suspicious_pct, mandant
from out group by mandant, strftime(d, '%Y-%m')"""

_CTES["labels_gt"] = """
select distinct konto, case (konto_num // 1000) % 5 when 1 then 'Rechnung Lieferant'
  when 2 then 'Miete und Pacht' when 3 then 'Gutschrift Bonus'
  when 4 then 'Storno und Korrektur' end as gt
from p where (konto_num // 1000) % 5 <> 0"""

_CTES["labelled"] = """
select p.*, coalesce(gt, case when row_id % 2 = 0 then 'Rechnung Sammelkonto' end) as label
from p left join labels_gt using (konto)"""

_CTES["eligible"] = """
select row_id, konto, buchungstext, label from labelled
where buchungstext <> '' and label <> '' and konto_num >= 40000 and konto_num < 80000"""

_VECTORS = """
v_chars as (select id, ' ' || lower(txt) || ' ' as c from v_texts where txt <> ''),
v_tf as (select id, g, count(*) as tf from (
  select id, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) as g
  from v_chars) group by all),
v_df as (select g, count(*) as df from v_tf group by 1),
v_raw as (select id, g, tf * ln(1 + (select count(distinct id) from v_tf) / df) as w
  from v_tf join v_df using (g)),
v as (select id, g, w / sqrt(sum(w * w) over (partition by id)) as w from v_raw)"""


def _vectors(name: str) -> str:
    """The vectors ``name`` of the texts ``<name>_texts``."""
    return re.sub(r"\bv(?=_\w|\b)", name, _VECTORS)


_CTES["v_texts_label"] = """
select txt as id, txt from (select buchungstext as txt from eligible union
  select label from eligible)"""

_CTES["label_pairs"] = "select distinct buchungstext as x, label as y from eligible"


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(_CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _with(sql: str, where: str = "true", extra: str = "", recursive: bool = False) -> str:
    """``sql`` preceded by the expressions it and ``extra`` refer to."""
    parts = [f"{n} as ({_CTES[n].strip().replace('{where}', where)})"
             for n in _needed(sql + " " + extra, [])]
    if extra:
        parts.append(extra.strip())
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql.strip()


def _oracle(name: str, sql: str, **options) -> None:
    ORACLES[name] = _with(sql, **options)


# --- sources and sinks -----------------------------------------------------------------------

_DATE_TEXT = """case when row_id % 3 = 0 then strftime({0}, '%Y-%m-%d %H:%M:%S') || '.000'
  when row_id % 3 = 1 then strftime({0}, '%d.%m.%Y') else strftime({0}, '%Y-%m-%d') end"""
_GERMAN = "replace(format('{:,}', abs(cents) // 100), ',', '.') || ',' || lpad(cast(abs(cents) % 100 as varchar), 2, '0')"
_READ = f"""
select row_id, {_DATE_TEXT.format('d')} as datum,
  case when cents < 0 then '-' else '' end || case row_id % 4 when 0 then {_GERMAN}
    when 1 then {_GERMAN} || ' €'
    when 2 then format('{{:,}}', abs(cents) // 100) || '.'
      || lpad(cast(abs(cents) % 100 as varchar), 2, '0')
    else cast(abs(cents) // 100 as varchar) || '.' || lpad(cast(abs(cents) % 100 as varchar), 2, '0')
    end as betrag,
  konto || '  ' as konto_soll, buchungstext || ' ' as buchungstext, belegnummer,
  nullif(kreditor, '') as kreditor, nullif(generalumgekehrt, '') as generalumgekehrt,
  nullif(lower(sh), '') as soll_haben, mandant
from p"""
_oracle("read_journal_csv", _READ)
_oracle("read_journal_csv_semicolon", _READ)
_oracle("journal_row_numbers", f"""
select row_number() over (order by row_id) - 1 as row_id, * exclude (row_id) from ({_READ.strip()})""")
_oracle("clean_nulls", "select row_id, nullif(kreditor, '') as Kreditor from p")
_oracle("prepared_parquet", """
select row_id, betrag as _betrag, a as _abs, strftime(d, '%Y-%m-%d') as datum, kl as _kontoklasse,
  st as _is_storno, dvbelegnummer as _beleg_id, signed as _betrag_signed, konto as konto_soll,
  coalesce(inferred_konto, '') as konto_haben, inferred_konto is not null as _konto_haben_inferred,
  kreditor, buchungstext
from p left join counterpart using (row_id)""")
_oracle("flags_parquet", "select row_id, " + ", ".join(f"flag_{n}" for n in _FLAGS)
        + ", score as _score from scored")
_oracle("export_csv", """
select row_id, strftime(d, '%Y-%m-%d') as datum, konto as konto_soll, betrag, belegnummer,
  round_even(score, 2) as anomaly_score, anomaly_flags from out where susp""")
_oracle("store_result", "select * from runs")
_oracle("list_runs", "select * from runs where mandant = '10' order by run_date desc")
_oracle("latest_run", """
select * from runs where (mandant, run_date) in (
  select (mandant, max(run_date)) from runs group by mandant)""")
_oracle("retain_last_n", """
select * exclude (k) from (
  select *, dense_rank() over (partition by mandant order by run_date desc) as k from runs)
where k <= 20""")
_oracle("gt_lookup", """
select row_id, coalesce(gt, case when row_id % 2 = 0 then 'Rechnung Sammelkonto' end)
  as gt_bezeichnung from p left join labels_gt using (konto)""")

_FIGURES = """
select count(*) as total_input, count(*) filter (susp) as total_suspicious,
  count(*) filter (susp) as total_output,
  format('{:.1f}%', count(*) filter (susp) / count(*) * 100) as filter_ratio,
  round(count(*) filter (susp) / count(*) * 100, 2) as suspicious_pct,
  round(avg(score), 2) as avg_score, max(score) as max_score, 25.5 as max_possible_score
from out"""
ORACLES["intake_stream"] = " union all ".join(
    f"select 'upload_1{m}' as upload, * from ({_with(_FIGURES, where=f'o_orderkey % 3 = {m}')})"
    for m in range(3))

# --- scalar functions ------------------------------------------------------------------------

_oracle("parse_amount", "select row_id, betrag as _betrag, a as _abs from p")
_oracle("parse_date", "select row_id, strftime(d, '%Y-%m-%d') as datum, ym as _ym from p")
_oracle("account_class", "select row_id, konto as konto_soll, kl as _kontoklasse from p")
_oracle("is_reversal", "select row_id, st as _is_storno from p")
_oracle("voucher_id", "select row_id, dvbelegnummer as _beleg_id from p")
_oracle("signed_amount", "select row_id, signed as _betrag_signed from p")
_oracle("mandant_detect", """
select mandant from p group by 1 order by count(*) desc, mandant limit 1""")
_oracle("derive_dims", """
select row_id, dayname(d) as "Wochentag", strftime(d, '%Y-%m') as "Monat",
  year(d) || 'Q' || quarter(d) as "Quartal", weekofyear(d) as "Kalenderwoche",
  case when score <= 0 then 'Unauffällig' when score <= 2 then 'Niedrig'
    when score <= 4 then 'Mittel' else 'Hoch' end as "Risiko-Kategorie",
  case when a <= 0 then null when a <= 100 then '<100€' when a <= 1000 then '100-1k€'
    when a <= 10000 then '1k-10k€' when a <= 100000 then '10k-100k€' else '>100k€' end
    as "Betrags-Klasse",
  """ + " + ".join(f"flag_{n}::int" for n in _FLAGS) + ' as "Anzahl_Flags" from scored')

# --- joins and self-relations ----------------------------------------------------------------

_oracle("counterpart_account", "select row_id, inferred_konto from counterpart")
_oracle("join_account_stats", """
select row_id, n as konto_count, round(hi, 2) as upper_limit, round(lo, 2) as lower_limit
from p left join limits using (konto)""")
_oracle("join_group_nunique", """
select row_id, n_vouchers, n_months from p join doc_groups using (belegnummer, konto, betrag)
where not st""")
_REGULAR = """select a, konto, kreditor, count(distinct ym) as n_months from p
  where ok and kreditor <> '' group by all having count(distinct ym) >= 6"""
_oracle("anti_regular", f"""
select row_id from p where ok and kreditor <> '' and (a, konto, kreditor) not in (
  select (a, konto, kreditor) from ({_REGULAR}))""")
_oracle("semi_outlier_months", """
select row_id, konto as konto_soll, strftime(d, '%Y-%m') as monat from p
where ok and pnl and (konto, ym) in (select (konto, ym) from spikes)""")
_oracle("consecutive_pair", """
select * from (select row_id, lag(row_id) over w as previous_id,
    cast(floor((epoch(d) - epoch(lag(d) over w)) / 86400) as bigint) as gap_days
  from p where ok and kreditor <> '' and (kreditor, a) in (
    select (kreditor, a) from p where ok and kreditor <> '' group by kreditor, a
    having count(*) <= 20)
  window w as (partition by kreditor, a order by d, row_id))
where previous_id is not null""")

# --- the tests -------------------------------------------------------------------------------

for _name in _FLAGS[:13]:
    _oracle(_name.lower(), f"select row_id from f_{_name.lower()}")

_LABEL_VECTORS = "v_texts as (select * from v_texts_label)," + _VECTORS + """,
cosines as (select x, y, coalesce(sum(l.w * r.w), 0) as c
  from label_pairs left join v l on l.id = x left join v r on r.id = y and r.g = l.g group by x, y),
sims as (select row_id, konto, buchungstext, label, c from eligible
  join cosines on x = buchungstext and y = label)"""
_oracle("text_konto_match", """
select row_id from sims where c < 0.3
  and konto in (select konto from eligible group by 1 having count(*) >= 5)""", extra=_LABEL_VECTORS)

# --- aggregation, statistics, scoring --------------------------------------------------------

_oracle("global_stats", """
select n as n_vals, round(mu, 4) as b_mean, round(sd, 4) as b_std, round(q3 - q1, 4) as b_iqr,
  round(q3 + 3.0 * (q3 - q1), 4) as b_fence from tot""")
_oracle("regular_patterns", f"""
select a as _abs, konto as konto_soll, kreditor as _kreditor_canonical, n_months
from p join ({_REGULAR}) using (a, konto, kreditor) group by all""")
_oracle("score", "select row_id, score as _score from scored")
_oracle("custom_weight_score", """
select row_id, score + flag_STORNO::int * 1.75 - flag_RECHNUNGSDATUM_PERIODE::int * 1.0 as _score
from scored""")
_oracle("flag_counts", "select flag, n from counts")
_oracle("suspicious_rows", """
select row_id, score as _score from out where susp order by score desc, row_id""")
_oracle("flag_string", "select row_id, anomaly_flags from out")
_EXPORT = """
select row_id, strftime(d, '%Y-%m-%d') as datum, konto as konto_soll, konto_haben, betrag,
  buchungstext, belegnummer, '' as kostenstelle, kreditor, lower(sh) as soll_haben,
  round_even(score, 2) as anomaly_score, anomaly_flags from out where susp"""
_oracle("export_projection", _EXPORT)
_oracle("full_analysis", _EXPORT)
_oracle("own_tests", """
select row_id, round_even(score + f1::int * 1.25::double + f2::int * 2.0::double, 2) as anomaly_score,
  concat_ws('|', nullif(anomaly_flags, ''), case when f1 then 'WOCHENENDE' end,
    case when f2 then 'TAGESHAEUFUNG' end) as anomaly_flags
from (select *, isodow(d) >= 6 and a > 0 and not st as f1,
    (konto, d) in (select (konto, d) from p group by konto, d having count(*) >= 3) as f2 from out)
where score + f1::int * 1.25::double + f2::int * 2.0::double >= 2.0 or crit or f2""")
_oracle("run_statistics", _FIGURES)
_oracle("enabled_tests", """
select flag, case when flag in ('BETRAG_ZSCORE', 'STORNO', 'NEAR_DUPLICATE') then n else 0 end as n
from counts""")
_oracle("run_single_test", """
select row_id, 'KONTO_BETRAG_ANOMALIE' as test_name from f_konto_betrag_anomalie""")
_oracle("merge_flags", """
select row_id, flag_STORNO, flag_NEUER_KREDITOR_HOCH, flag_BELEG_KREDITOR_DUPLIKAT,
  flag_STORNO::int * 1.5 + flag_NEUER_KREDITOR_HOCH::int * 2.5
    + flag_BELEG_KREDITOR_DUPLIKAT::int * 2.5 as _score
from scored""")

_FILLED = {
    "datum": "true", "betrag": "true", "konto_soll": "true", "buchungstext": "buchungstext <> ''",
    "belegnummer": "true", "kreditor": "kreditor <> ''", "soll_haben": "sh <> ''",
    "erfassungsdatum": "true", "generalumgekehrt": "generalumgekehrt <> ''",
    "dvbelegnummer": "true", "mandant": "true",
}
_PROFILE = " union all ".join(
    f"select '{c}' as column_name, "
    + (f"round(avg(({_FILLED[c]})::int::double) * 100, 1) as fill_pct, true as have from p"
       if c in _FILLED else "0.0 as fill_pct, false as have")
    for c in CANONICAL_COLUMNS)
_CTES["profile"] = _PROFILE
_oracle("column_profile", """
select column_name, fill_pct, case when not have then 'missing' when fill_pct = 0 then 'empty'
  when fill_pct < 50 then 'sparse' else 'ok' end as status from profile""")
_NEEDS = ", ".join(
    f"('{test}', {place}, '{column}', {str(needed).lower()})"
    for test, (required, optional) in TEST_COLUMNS.items()
    for place, (column, needed) in enumerate(
        [(c, True) for c in required] + [(c, False) for c in optional]))
_oracle("test_readiness", f"""
select test, case when blocked <> '' then 'blocked' when thin <> '' or opt <> '' then 'degraded'
    else 'ok' end as status,
  case when blocked <> '' then blocked || ' leer' when thin <> '' then thin || ' dünn besetzt'
    when opt <> '' then opt || ' leer → eingeschränkt' else '' end as reason
from (select test,
    coalesce(string_agg(column_name, ', ' order by place) filter (needed and fill_pct = 0), '')
      as blocked,
    coalesce(string_agg(column_name || format(' ({{:.0f}}%)', fill_pct), ', ' order by place)
      filter (needed and fill_pct > 0 and fill_pct < 50), '') as thin,
    coalesce(string_agg(column_name, ', ' order by place)
      filter (not needed and fill_pct = 0), '') as opt
  from (values {_NEEDS}) n(test, place, column_name, needed) join profile using (column_name)
  group by test)""")
_oracle("validation_warnings", """
select column_name, fill_pct, case
    when column_name = 'konto_haben' then 'counter account sparse, filled from two-row vouchers'
    when fill_pct = 0 then 'marker missing, booked sign is used'
    else 'marker sparse, signs partly inexact' end as warning
from profile where column_name in ('soll_haben', 'konto_haben') and fill_pct < 50""")
_CTES["konto_months"] = """
select konto as konto_soll, strftime(d, '%Y-%m') as monat, round(sum(a), 2) as summe
from p where a > 0 group by all"""
_oracle("monthly_account_sums", "select * from konto_months")
_oracle("save_run", """
select (select mandant from p group by 1 order by count(*) desc, mandant limit 1) as mandant,
  '2001-09-01T00:00:00' as run_date, 'journal.csv' as file, (select count(*) from p) as total_rows,
  (select round(count(*) filter (susp) / count(*) * 100, 2) from out) as suspicious_pct, flag, n
from counts""")
_oracle("save_run_months", """
select (select mandant from p group by 1 order by count(*) desc, mandant limit 1) as mandant,
  '2001-09-01T00:00:00' as run_date, 'journal.csv' as file, m.* from konto_months m""")
_oracle("last_run", """
select * exclude (k) from (
  select *, row_number() over (partition by mandant order by run_date desc) as k from runs)
where k = 2""")


def _side(where: str) -> dict[str, str]:
    return {part: "(" + _with(sql, where=where) + ")" for part, sql in {
        "counts": "select flag, n from counts",
        "share": "select round(count(*) filter (susp) / count(*) * 100, 2) as pct from out",
        "accounts": "select distinct konto_soll from konto_months"}.items()}


_now, _then = _side("true"), _side("o_orderdate < timestamp '2001-01-01'")
ORACLES["compare_runs"] = f"""
select 'flag' as kind, flag as name, n.n::double as current, t.n::double as previous,
  (n.n - t.n)::double as delta
from {_now['counts']} n join {_then['counts']} t using (flag) where n.n <> t.n
union all select 'share', 'suspicious_pct', n.pct, t.pct, round(n.pct - t.pct, 2)
from {_now['share']} n, {_then['share']} t
union all select 'new account', konto_soll, null, null, null
from (select * from {_now['accounts']} except select * from {_then['accounts']})
union all select 'removed account', konto_soll, null, null, null
from (select * from {_then['accounts']} except select * from {_now['accounts']})"""

_CTES["reviews"] = """
select mandant, row_id as row_index, belegnummer, round_even(score, 2) as anomaly_score,
  anomaly_flags, case when row_id % 5 < 2 then 'tp' when row_id % 5 < 4 then 'fp' else 'unsure' end
  as label, 'QS' as pruefer, '2001-09-01T08:00:00' as labeled_at
from out where row_id % 10 <> 9"""
_CTES["flag_reviews"] = """
select trim(unnest(string_split(anomaly_flags, '|'))) as flag, label from reviews"""
_CTES["tallies"] = """
select coalesce(flag, 'GESAMT') as flag, count(*) filter (label = 'tp') as tp,
  count(*) filter (label = 'fp') as fp, count(*) filter (label = 'unsure') as unsure
from flag_reviews where flag <> '' group by rollup (flag)"""
_oracle("feedback_save", "select * from reviews")
_oracle("label_counts", """
select coalesce(mandant, 'ALL') as mandant, count(*) as n_labels, count(*) >= 200 as stats_open,
  count(*) >= 500 as training_open from reviews group by rollup (mandant)""")
_oracle("feedback_stats", """
select flag, tp, fp, unsure,
  case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision,
  case when tp + fp > 0 then round(fp / (tp + fp), 6) else 0 end as fp_rate
from tallies""")
_DEFAULTS = ", ".join(f"('{n}', {w})" for n, w in zip(_FLAGS, _POINTS))
_oracle("reweight", f"""
select flag, greatest(0.1, least(5.0, round_even(w::double * (0.5 + tp / (tp + fp)), 2))) as weight
from tallies join (values {_DEFAULTS}) d(flag, w) using (flag) where tp + fp >= 10""")
_oracle("threshold_sweep", """
select round(i * 0.05, 2) as threshold,
  (select count(*) from sims where c < round(i * 0.05, 2)) as n_anomalies,
  round((select count(*) from sims where c < round(i * 0.05, 2))
    / (select count(*) from sims) * 100, 1) as pct,
  coalesce((select string_agg(konto || ' ' || label || ' ' || buchungstext, '; '
      order by c, row_id)
    from (select * from sims order by c, row_id limit 3) where c < round(i * 0.05, 2)), '')
    as examples
from range(1, 19) r(i)""", extra=_LABEL_VECTORS)
_SPOTS = [10, 20, 30, 40, 50, 60, 70, 80, 90]
_oracle("similarity_percentiles", " union all ".join(
    f"select 'p{k}' as measure, round(quantile_cont(c, {k / 100}), 5) as value, "
    f"count(*) filter (c < (select quantile_cont(c, {k / 100}) from sims)) as n_below from sims"
    for k in _SPOTS) + """
union all select 'mean', round(avg(c), 5), null from sims
union all select 'std', round(stddev_pop(c), 5), null from sims
union all select 'min', round(min(c), 5), null from sims
union all select 'max', round(max(c), 5), null from sims""", extra=_LABEL_VECTORS)

# --- what intake stores beside the totals ----------------------------------------------------


def _per_upload(sql: str) -> str:
    return " union all ".join(
        f"select 'upload_1{m}' as upload, * from ({_with(sql, where=f'o_orderkey % 3 = {m}')})"
        for m in range(3))


ORACLES["intake_suspicious"] = _per_upload(_EXPORT)
ORACLES["intake_months"] = _per_upload(
    "select (select min(mandant) from p) as mandant, m.* from konto_months m")

# --- vectors and entity resolution -----------------------------------------------------------

ORACLES["text_vectors"] = (
    "with v_texts as (select conv_id || '-' || turn as id, text as txt from conversations),"
    + _VECTORS + " select id as turn_id, g as gram, round(w, 6) as weight from v")
ORACLES["cosine_pairs"] = """
select x.vec_id as id_a, y.vec_id as id_b,
  round(list_dot_product(x.embedding::double[], y.embedding::double[]), 6) as cosine
from embeddings x join embeddings y on y.vec_id = x.vec_id + 1"""
_CLUSTERS = """
vendor_names as (select kreditor, min(row_id) as first_row from p where kreditor <> '' group by 1),
n_texts as (select kreditor as id, kreditor as txt from vendor_names),""" + _vectors("n") + """,
near as (select l.id as x, r.id as y from n l join n r using (g) group by all
  having sum(l.w * r.w) >= 0.8 - 1e-9),
walk(x, y) as (select x, y from near union select w.x, m.y from walk w join near m on m.x = w.y),
comp as (select x, min(y) as root from walk group by x),
reach as (select x, root from comp),
canon as (select kreditor, coalesce((
    select m.kreditor from vendor_names m join reach r2 on r2.x = m.kreditor
    where r2.root = c.root order by length(m.kreditor), m.first_row limit 1), kreditor) as canonical
  from vendor_names left join comp c on c.x = kreditor)"""
_oracle("vendor_clusters", "select kreditor, canonical from canon", recursive=True, extra=_CLUSTERS)
_oracle("canonical_vendor_join", """
select row_id, coalesce(canonical, kreditor) as _kreditor_canonical
from p left join canon using (kreditor)""", recursive=True, extra=_CLUSTERS)

_ALIKE = """
v_texts as (select distinct buchungstext as id, buchungstext as txt from p),""" + _VECTORS + """,
same as (select l.id as x, r.id as y from v l join v r using (g) group by all
  having sum(l.w * r.w) >= 0.85),
close_rows as (select *, case when kreditor <> '' then 'k' || kreditor else 't' end as who
  from {rows} where ok),
close_groups as (select a, konto, who from close_rows group by all
  having count(*) between 2 and 10 and count(distinct ym) < 6),
close_seq as (select row_id, buchungstext, lag(row_id) over w as prev,
    lag(buchungstext) over w as prev_text,
    floor((epoch(d) - epoch(lag(d) over w)) / 86400) between 1 and 3
      and dvbelegnummer <> lag(dvbelegnummer) over w as close_by
  from close_rows join close_groups using (a, konto, who)
  window w as (partition by a, konto, who order by d, row_id)),
alike as (
  select row_id from close_seq join same on x = buchungstext and y = prev_text where close_by
  union select prev from close_seq join same on x = buchungstext and y = prev_text where close_by)"""
_oracle("near_duplicate_similar_texts", "select row_id from alike",
        extra=_ALIKE.replace("{rows}", "p"))

_GIVEN = """
given as (select txt, embedding::double[] as e from (select distinct buchungstext as txt from p) join embeddings
  on vec_id = ('0x' || substr(md5(txt), 1, 8))::bigint % (select count(*) from embeddings)),
same as (select l.txt as x, r.txt as y from given l join given r on list_cosine_similarity(l.e, r.e) >= 0.1),
close_rows as""" + _ALIKE.split("close_rows as", 1)[1]
_oracle("near_duplicate_given_vectors", "select row_id from alike", extra=_GIVEN.replace("{rows}", "p"))

ORACLES["embedding_clusters"] = """
with recursive names as (select 'V' || vec_id as name, vec_id as id, embedding::double[] as e from embeddings),
near as (select l.name as x, r.name as y from names l join names r on list_cosine_similarity(l.e, r.e) >= 0.42 - 1e-9),
walk(x, y) as (select x, y from near union select w.x, m.y from walk w join near m on m.x = w.y),
comp as (select x, min(y) as root from walk group by x)
select c.x as kreditor, (select n.name from comp d join names n on n.name = d.x where d.root = c.root
  order by length(n.name), n.id limit 1) as canonical from comp c"""

# text mode: the rules that look at vendors see canonical names
_BY_VENDOR = ["vendor_docs", "regular_vendor", "level1", "level2_groups", "level2",
              "f_beleg_kreditor_duplikat", "f_neuer_kreditor_hoch"]


def _on_canonical(sql: str) -> str:
    for name in _BY_VENDOR:
        sql = re.sub(rf"\b{name}\b", f"q_{name}", sql)
    return re.sub(r"\bp\b", "q", sql)


_oracle("full_analysis_text", _EXPORT.replace("from out", "from text_out"), recursive=True,
        extra=_CLUSTERS + """,
q as (select p.* replace (coalesce(canonical, kreditor) as kreditor)
  from p left join canon using (kreditor)),""" + ",".join(
            f"\nq_{n} as ({_on_canonical(_CTES[n])})" for n in _BY_VENDOR)
        + "," + _ALIKE.replace("{rows}", "q") + ",\n"
        + re.sub(r"\bv(?=_\w|\b)(?!_texts_label)", "m", _LABEL_VECTORS) + f""",
mismatched as (select row_id from sims where c < 0.3
  and konto in (select konto from eligible group by 1 having count(*) >= 5)),
text_flags as (select * exclude (score, crit) replace (
    row_id in (select row_id from alike) as flag_NEAR_DUPLICATE,
    row_id in (select row_id from q_f_beleg_kreditor_duplikat) as flag_BELEG_KREDITOR_DUPLIKAT,
    row_id in (select row_id from q_f_neuer_kreditor_hoch) as flag_NEUER_KREDITOR_HOCH,
    row_id in (select row_id from mismatched) as flag_TEXT_KONTO_MATCH) from scored),
text_scored as (select *, {" + ".join(f"flag_{n}::int * {w}::double" for n, w in zip(_FLAGS, _POINTS))}
    as score, ({" or ".join(f"flag_{n}" for n in _DECISIVE)}) as crit from text_flags),
text_out as ({_CTES["out"].replace("from scored", "from text_scored")})""")

# --- chart data ------------------------------------------------------------------------------

_oracle("score_histogram", """
select bin, round(lo + bin * width, 6) as lower, count(*) as n, mean_score
from (select least(cast(floor((score - lo) / width) as integer), 49) as bin, lo, width, mean_score
  from scored, (select min(score) as lo, (max(score) - min(score)) / 50 as width,
    round(avg(score), 2) as mean_score from scored))
group by all""")
_oracle("flag_frequency", "select flag, n from counts where n > 0 order by n, flag")
_PNL = """
select strftime(d, '%Y-%m') as monat, kl as kontoklasse, round(sum(signed), 2) as summe
from p where {} group by all"""
_oracle("monthly_pnl", _PNL.format("true"))
_oracle("income_expense_monthly", _PNL.format("pnl"))
_oracle("top_accounts", """
select konto as konto_soll, round(avg(score), 6) as avg_score, count(*) as n_flagged
from scored where score > 0 group by 1 order by avg(score) desc, konto limit 10""")
_oracle("volume_heatmap", """
select dayname(d) as wochentag, strftime(d, '%Y-%m') as monat, count(*) as n from p group by all""")
_oracle("amount_vs_score", """
select row_id, a as _abs, score as _score, string_split(anomaly_flags, '|')[1] as top_flag
from out where score > 0""")
_oracle("vendor_treemap", """
select kreditor, round(sum(a), 2) as summe, round(avg(score), 6) as avg_score, count(*) as n
from scored where kreditor <> '' group by 1 having count(*) >= 2
order by summe desc, kreditor limit 30""")
_oracle("account_timeline", """
select row_id, konto as konto_soll, strftime(d, '%Y-%m-%d') as datum, betrag as _betrag,
  score > 0 as anomalie
from scored where konto = (select konto from scored where score > 0 group by 1
  order by avg(score) desc, konto limit 1)""")
_oracle("debit_credit_balance", """
select konto as konto_soll, round(coalesce(sum(signed) filter (sh = 'S'), 0), 2) as soll,
  round(coalesce(sum(signed) filter (sh = 'H'), 0), 2) as haben,
  round(abs(round(coalesce(sum(signed) filter (sh = 'S'), 0), 2)
    - round(coalesce(sum(signed) filter (sh = 'H'), 0), 2)), 2) as diff
from p where sh <> '' group by 1 order by diff desc, konto limit 15""")
_oracle("landscape_3d", """
select row_id, a as _abs, konto_num::double as konto_num,
  datediff('day', (select min(d) from p), d) as tage, score as _score from scored""")
_oracle("downsample", """
select row_id from (
  select row_id, score, row_number() over (partition by score > 0 order by md5('42-' || row_id))
    as k from scored)
where score > 0 or k <= (select cast(floor(count(*) * 0.9) as bigint)
  - count(*) filter (score > 0) from scored)""")
_oracle("column_null_share", """
select column_name, round(share * 100, 1) as null_pct, share > 0.5 as warn from (
  select 'kreditor' as column_name, avg((kreditor = '')::int) as share from p
  union all select 'buchungstext', 0.0
  union all select 'generalumgekehrt', 0.0
  union all select 'soll_haben', 0.0)""")
