"""A booking journal in export form, derived from the ``orders`` table.

One order is one posting line.  Numbers and dates are rendered as the mixed text a ledger export
contains, so reading and parsing are exercised on every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from journalsieve.workspace import spread

_MAPPING = """
with b as (
  select o_orderkey as row_id, o_custkey as ck, o_orderdate as d, o_orderpriority as pr,
         o_totalprice as tp,
         o_orderkey % 29 = 0 as is_bulk,
         o_orderkey % 31 = 0 and o_orderkey % 29 <> 0 as is_partner,
         o_orderkey % 97 = 1 as is_big,
         o_orderkey % 37 = 0 as is_korr,
         cast(year(o_orderdate) as string) || '-' || cast(quarter(o_orderdate) as string) as yq,
         cast(floor(o_orderkey / 2) as bigint) as half
  from {orders})
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
       else 'B-' || cast(half as string) end as belegnummer,
  case when is_partner then 'Partner ' || yq
       when is_big and ck % 4 = 0 then 'Neu ' || cast(row_id as string)
       when row_id % 7 = 0 then '' else 'Kreditor ' || cast(ck % 40 as string) end as kreditor,
  'DV-' || cast(half as string) as dvbelegnummer,
  case when row_id % 41 = 0 then 'DV-' || cast(half + 1 as string) || ';'
       when row_id % 43 = 0 then '0.0' else '' end as generalumgekehrt,
  case when row_id % 5 = 0 then '' when row_id % 2 = 0 then 'S' else 'H' end as soll_haben,
  '1' || cast(row_id % 3 as string) as mandant,
  row_id % 9 * 20 as lag_days
from b
"""


def order_postings(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """The typed posting attributes of every order, or of the orders before a date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if before:
        orders = orders.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    return spark.sql(_MAPPING, orders=spread(orders))


def _amount_text(cents: F.Column, row_id: F.Column) -> F.Column:
    """German, English, plain and currency renderings in turn."""
    sign = F.when(cents < 0, "-").otherwise("")
    units = F.floor(F.abs(cents) / 100).cast("string")
    rest = F.lpad(F.pmod(F.abs(cents), F.lit(100)).cast("string"), 2, "0")
    dotted = F.regexp_replace(units, r"(\d)(?=(\d{3})+$)", "$1.")
    german = F.concat(sign, dotted, F.lit(","), rest)
    return (
        F.when(row_id % 4 == 0, german)
        .when(row_id % 4 == 1, F.concat(german, F.lit(" €")))
        .when(row_id % 4 == 2,
              F.concat(sign, F.replace(dotted, F.lit("."), F.lit(",")), F.lit("."), rest))
        .otherwise(F.concat(sign, units, F.lit("."), rest))
    )


def _date_text(day: F.Column, row_id: F.Column) -> F.Column:
    """Database timestamps, ISO dates and German dates in turn."""
    return (
        F.when(row_id % 3 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(row_id % 3 == 1, F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def order_export(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """The postings as a source system would export them: own header names, text only.

    ``row_id`` is kept beside the text columns as the source key.
    """
    p = order_postings(spark, sf_dir, before)
    row = F.col("row_id")
    entered = F.col("d") + F.make_dt_interval(F.col("lag_days"))
    return p.select(
        "row_id",
        _date_text(F.col("d"), row).alias("Belegdatum"),
        _amount_text(F.col("cents"), row).alias("FiBuBetrag"),
        F.concat(F.col("konto_num").cast("string"), F.lit("  ")).alias("Kontonummer"),
        F.concat("buchungstext", F.lit(" ")).alias("Buchungstext"),
        F.col("belegnummer").alias("Belegnummer"),
        F.when(F.col("kreditor") == "", "NULL").otherwise(F.col("kreditor")).alias("Kreditor"),
        F.col("dvbelegnummer").alias("DVBelegnummer"),
        F.col("generalumgekehrt").alias("Generalumgekehrt"),
        F.lower("soll_haben").alias("Soll/Haben"),
        _date_text(entered, row).alias("ErfassungAm"),
        F.when(row % 2 == 0, "Rechnung Sammelkonto").otherwise("").alias("Bezeichnung"),
        F.col("mandant").alias("Mandant"),
    )


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account labels for four in five accounts of the journal."""
    thousands = F.col("konto_num") / 1000
    kind = F.pmod(thousands.cast("int"), F.lit(5))
    label = (
        F.when(kind == 1, "Rechnung Lieferant").when(kind == 2, "Miete und Pacht")
        .when(kind == 3, "Gutschrift Bonus").when(kind == 4, "Storno und Korrektur")
    )
    return (
        order_postings(spark, sf_dir).select("konto_num").distinct()
        .select(F.col("konto_num").cast("string").alias("konto_soll"),
                label.alias("gt_bezeichnung"))
        .filter("gt_bezeichnung is not null")
    )
