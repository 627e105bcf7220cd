"""A join whose hot keys are dealt over several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that each key of the larger side is dealt over; the smaller side is repeated as often.
PLACES = 16


def dealt_left_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: Column, places: int = PLACES) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row for each of ``keys``), where one key may hold a large part of ``rows``.

    ``by`` tells rows of one key apart; its hash picks the place. ``facts`` are far
    fewer than ``rows`` (one row for each host, or for each text that occurs again).
    """
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(places)).cast("int"))
    each = facts.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return dealt.join(each, [*keys, "_place"], "left").drop("_place")
