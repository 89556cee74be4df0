"""Near duplicates, repeated document numbers, repeated vendor documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.functions.dates import whole_days
from journalsieve.operators.context import Context
from journalsieve.operators.groups import distinct_over, rows_in_small_groups
from journalsieve.operators.parts import Part, RowIds, counted_amounts
from journalsieve.operators.text_vectors import pair_cosines
from journalsieve.workspace import settle

_LEVEL1_VOUCHERS = 4
_LEVEL2_DOCUMENTS = 3
_MIN_REGULAR_MONTHS = 6


def regular_groups(rows: DataFrame, keys: list[str], min_months: int | Column) -> DataFrame:
    """Keys booked in at least ``min_months`` different months: a regular payment."""
    return (
        rows.filter(F.col("_ym").isNotNull())
        .groupBy(*keys).agg(F.count_distinct("_ym").alias("n_months"))
        .filter(F.col("n_months") >= min_months)
    )


def _unlike_previous(column: str, order) -> Column:
    return F.col(column) != F.lag(column).over(order)


# --- near duplicates -------------------------------------------------------------------------

_SAME_POSTING = ["_abs", "konto_soll", "partner"]


def near_duplicate_groups(ctx: Context) -> DataFrame:
    """Rows of equal amount, account and partner, in groups small enough and not regular.

    The partner is the vendor.  Without a vendor it is the text, or nothing when text vectors
    decide on similarity.  One key column serves both cases, so the journal is shuffled once.
    """
    c = ctx.config
    text = F.lit("") if _compares_texts(ctx) else F.col("buchungstext")
    partner = F.when(F.col("_kreditor_canonical") != "",
                     F.concat(F.lit("k:"), F.col("_kreditor_canonical"))) \
        .otherwise(F.concat(F.lit("t:"), text))
    rows = (
        ctx.journal.filter(counted_amounts()).withColumn("partner", partner)
        .select("row_id", *_SAME_POSTING, "buchungstext", "_datum", "_ym", "_beleg_id")
    )
    members = Window.partitionBy(*_SAME_POSTING)
    return (
        rows_in_small_groups(rows, _SAME_POSTING, c.near_duplicate_max_group_size)
        .filter("group_rows >= 2")
        .withColumn("n_months", distinct_over(F.col("_ym"), members))
        .filter(F.col("n_months") < c.near_duplicate_regular_months)
    )


def _compares_texts(ctx: Context) -> bool:
    return ctx.vectors is not None and ctx.config.near_duplicate_text_similarity > 0


def _consecutive(groups: DataFrame, keys: list[str], low: int, high: int,
                 unlike: list[str]) -> DataFrame:
    """Each row compared with its predecessor by date: ``close`` and the predecessor's id."""
    order = Window.partitionBy(*keys).orderBy("_datum", "row_id")
    gap = whole_days(F.lag("_datum").over(order), F.col("_datum"))
    differ = reduce(lambda a, b: a & b, [_unlike_previous(u, order) for u in unlike])
    return groups.withColumns({
        "close": F.coalesce(gap.between(low, high) & differ, F.lit(False)),
        "previous_id": F.lag("row_id").over(order),
        "previous_text": F.lag("buchungstext").over(order),
    })


def _pair_members(compared: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
    """Both rows of every close pair, read off the same ordered window; ``also`` adds rows."""
    order = Window.partitionBy(*keys).orderBy("_datum", "row_id")
    member = F.col("close") | F.col("next_close")
    return (
        compared.withColumn("next_close", F.lead("close", 1, False).over(order))
        .filter(member if also is None else member | also).select("row_id")
    )


def _alike_members(ctx: Context, compared: DataFrame) -> DataFrame:
    """Both rows of the close pairs whose texts are similar enough."""
    pairs = compared.filter("close").select(
        "row_id", "previous_id", F.col("buchungstext").alias("a"),
        F.col("previous_text").alias("b"))
    alike = pair_cosines(pairs, ctx.vectors).filter(
        F.col("cosine") >= ctx.config.near_duplicate_text_similarity)
    ids = pairs.join(alike, ["a", "b"], "left_semi")
    return ids.select(F.explode(F.array("row_id", "previous_id")).alias("row_id")).distinct()


def near_duplicate(ctx: Context) -> list[Part]:
    """Undated rows repeated under several vouchers, and dated rows a few days apart."""
    c = ctx.config
    members = Window.partitionBy(*_SAME_POSTING)
    undated = F.col("_datum").isNull()
    groups = near_duplicate_groups(ctx)
    if _compares_texts(ctx):
        groups = settle(groups, "near_duplicate_groups")  # read by both branches below
    groups = groups.withColumns({
        "n_undated": F.count_if(undated).over(members),
        "undated_vouchers": distinct_over(F.when(undated, F.col("_beleg_id")), members),
    })
    repeated = undated & (F.col("n_undated") >= 2) & (F.col("undated_vouchers") > 1)
    compared = _consecutive(groups, _SAME_POSTING, 1, c.near_duplicate_days, ["_beleg_id"])
    if _compares_texts(ctx):
        # undated rows never close a pair, so the two sets are disjoint
        return [RowIds(groups.filter(repeated).select("row_id")),
                RowIds(_alike_members(ctx, compared))]
    return [RowIds(_pair_members(compared, _SAME_POSTING, also=repeated))]


# --- repeated document numbers ---------------------------------------------------------------

_SAME_DOCUMENT = ["belegnummer", "konto_soll", "_betrag"]


def _documents_in_scope(ctx: Context) -> Column:
    scope = (F.col("belegnummer") != "") & ~F.col("_is_storno")
    for prefix in ctx.config.ignored_prefixes:
        scope = scope & ~F.upper("belegnummer").startswith(prefix)
    return scope


def voucher_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Different vouchers and booked months per key; both counts combine before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.count_distinct("_beleg_id").alias("n_vouchers"),
        F.count_distinct("_ym").alias("n_months"))


def doppelte_belegnummer(ctx: Context) -> list[Part]:
    c = ctx.config
    rows = ctx.journal.filter(_documents_in_scope(ctx))
    # months matter only for the few keys with enough vouchers; one distinct count each expands no row
    candidates = settle(
        rows.groupBy(*_SAME_DOCUMENT).agg(F.count_distinct("_beleg_id").alias("n_vouchers"))
        .filter(F.col("n_vouchers") >= c.doppelte_beleg_min_count).drop("n_vouchers"), "document_candidates")
    repeated = (
        rows.join(candidates, _SAME_DOCUMENT, "left_semi").groupBy(*_SAME_DOCUMENT)
        .agg(F.count_distinct("_ym").alias("n_months"))
        .filter(F.col("n_months") < c.doppelte_beleg_regular_months))
    if c.doppelte_beleg_min_count <= 2:
        # a debit/credit pair has two rows, so it can only matter for a minimum of two
        mark = F.col("_seite")
        pairs = rows.groupBy("belegnummer").agg(
            F.count(F.lit(1)).alias("n"), F.count(mark).alias("marked"),
            F.count_if(mark == "S").alias("debits"),
        ).filter("n = 2 and marked = 2 and debits = 1")
        repeated = repeated.join(pairs, "belegnummer", "left_anti")
    table = settle(repeated.select(*_SAME_DOCUMENT), "repeated_documents")
    # only ids and keys meet the table: the journal itself is not shuffled by document
    return [RowIds(rows.select("row_id", *_SAME_DOCUMENT).join(table, _SAME_DOCUMENT, "left_semi")
                   .select("row_id"))]


# --- repeated vendor documents ---------------------------------------------------------------

_VENDOR_AMOUNT = ["_kreditor_canonical", "_abs"]


def _vendor_documents() -> Column:
    return ((F.col("belegnummer") != "") & (F.col("_kreditor_canonical") != "")
            & ~F.col("_is_storno"))


def regular_month_limit(ctx: Context) -> Column:
    """Months that make a payment regular: a share of all booked months, at least six."""
    months = ctx.journal.agg(F.count_distinct("_ym")).scalar()
    share = F.floor(months * F.lit(ctx.config.beleg_kreditor_regular_pct))
    return F.greatest(F.lit(_MIN_REGULAR_MONTHS), share)


def repeated_vendor_documents(ctx: Context) -> DataFrame:
    """Level 1 keys: one document number, vendor and amount under four or more vouchers."""
    keys = ["belegnummer", *_VENDOR_AMOUNT]
    rows = ctx.journal.filter(_vendor_documents())
    repeated = settle(
        rows.groupBy(*keys).agg(F.count_distinct("_beleg_id").alias("n_vouchers"))
        .filter(F.col("n_vouchers") >= _LEVEL1_VOUCHERS).select(*keys), "vendor_documents")
    # months only matter for the few vendors and amounts that repeat
    candidates = rows.join(repeated.select(*_VENDOR_AMOUNT).distinct(), _VENDOR_AMOUNT, "left_semi")
    regular = regular_groups(candidates, _VENDOR_AMOUNT, regular_month_limit(ctx))
    return repeated.join(regular, _VENDOR_AMOUNT, "left_anti")


def vendor_amount_pairs(ctx: Context) -> DataFrame:
    """Level 2 rows: equal vendor and amount on neighbouring days under different documents."""
    c = ctx.config
    members = Window.partitionBy(*_VENDOR_AMOUNT)
    rows = ctx.journal.filter(
        _vendor_documents() & (F.col("_abs") > 0) & F.col("_datum").isNotNull())
    groups = (
        rows_in_small_groups(
            rows.select("row_id", *_VENDOR_AMOUNT, "belegnummer", "_beleg_id", "buchungstext",
                        "_datum", "_ym"),
            _VENDOR_AMOUNT, c.beleg_kreditor_max_group_size)
        .filter("group_rows >= 2")
        .withColumns({
            "n_documents": distinct_over(F.col("belegnummer"), members),
            "n_days": distinct_over(F.dayofmonth("_datum"), members),
            "n_months": distinct_over(F.col("_ym"), members),
        })
        .filter((F.col("n_documents") >= _LEVEL2_DOCUMENTS) & (F.col("n_days") > 1)
                & (F.col("n_months") < regular_month_limit(ctx)))
    )
    compared = _consecutive(groups, _VENDOR_AMOUNT, 0, c.beleg_kreditor_days,
                            ["belegnummer", "_beleg_id"])
    return _pair_members(compared, _VENDOR_AMOUNT)


def beleg_kreditor_duplikat(ctx: Context) -> list[Part]:
    keys = ["belegnummer", *_VENDOR_AMOUNT]
    rows = ctx.journal.filter(_vendor_documents()).select("row_id", *keys)
    repeated = rows.join(repeated_vendor_documents(ctx), keys, "left_semi").select("row_id")
    return [RowIds(repeated), RowIds(vendor_amount_pairs(ctx))]
