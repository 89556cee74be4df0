"""New vendors with high amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from journalsieve.operators.context import Context
from journalsieve.operators.groups import rows_in_small_groups
from journalsieve.operators.parts import Part, RowIds
from journalsieve.operators.postings import sigma_limit


def neuer_kreditor_hoch(ctx: Context) -> list[Part]:
    c = ctx.config
    booked = ctx.journal.filter((F.col("_kreditor_canonical") != "") & ~F.col("_is_storno"))
    rare = rows_in_small_groups(
        booked.select("row_id", "_kreditor_canonical", "_abs"),
        ["_kreditor_canonical"], c.new_kreditor_max_bookings)
    high = F.col("_abs") > sigma_limit(ctx, c.new_kreditor_amount_sigma)
    return [RowIds(rare.filter(high).select("row_id"))]
