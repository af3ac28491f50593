"""Versioned histories of changing attributes, from raw statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_day(c: Column) -> Column:
    """First ten characters of an ISO date or date-time, NULL unless they form a calendar date."""
    return F.date_format(F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def value_key(c: Column) -> Column:
    """Key under which two JSON values are the same: no case, no white space, numbers by amount.

    A number counts as a number whether quoted or not; it is written without trailing zeros.
    """
    bare = F.lower(F.regexp_replace(c, r"[\s ]+", ""))
    unquoted = F.regexp_replace(bare, r'^"(.*)"$', "$1")
    number = F.regexp_extract(unquoted, r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", 0)
    sign = F.regexp_extract(unquoted, r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", 1)
    whole = F.regexp_extract(unquoted, r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", 2)
    part = F.regexp_extract(unquoted, r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", 3)
    amount = F.concat(
        F.when((sign == "-") & ((whole != "") | (part != "")), "-").otherwise(""),
        F.when(whole == "", "0").otherwise(whole),
        F.when(part == "", "").otherwise(F.concat(F.lit("."), part)),
    )
    scientific = unquoted.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?e[+-]?[0-9]+$")
    return (
        F.when(number.rlike("[0-9]"), F.concat(F.lit("#"), amount))
        .when(scientific, F.concat(F.lit("#"), F.regexp_replace(unquoted.cast("double").cast("decimal(38,6)").cast("string"), r"\.?0+$", "")))
        .otherwise(unquoted)
    )


def versions(
    rows: DataFrame,
    keys: list[str],
    start: str,
    value: str,
    own_end: str | None = None,
    rank: list[str] | None = None,
) -> DataFrame:
    """Fold dated statements into versions ``(*keys, valid_from, valid_to, value)``.

    Of the statements of one key and start the one with the greatest ``rank`` columns counts.
    A statement holds until the next counting start of its key or its own end, whichever comes
    first; one that would hold for no time is no version (but still ends the one before).
    Touching versions of equal value are one. ``valid_to`` is NULL where open. ``start`` and
    ``own_end`` are ISO days (strings that order as text); statements without a start are ignored,
    NULL keys form their own group, a NULL value is a value.

    Layout: the choice among equal starts is a partial aggregate (``max_by``), so a hot key is
    reduced to one row per distinct day before it is shuffled; only then the days of a key are
    gathered into one sorted array (bounded by the calendar, not by the rows) and folded by a
    higher-order function that appends a version only upon change.
    """
    rank = rank or []
    end = F.col(own_end) if own_end else F.lit(None).cast("string")
    picked = (
        rows.filter(F.col(start).isNotNull())
        .groupBy(*keys, F.col(start).alias("_from"))
        .agg(F.max(F.struct(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(rank)], F.col(value).alias("v"), end.alias("e"))).alias("_m"))
    )
    days = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_from").alias("s"), F.col("_m.v").alias("v"), F.col("_m.e").alias("e")))).alias("_d"))
    spans = F.transform(
        "_d",
        lambda x, i: F.struct(
            x["s"].alias("s"),
            # least() skips NULLs: the next start and the own end, whichever is there and earlier
            F.least(F.get("_d", i + 1)["s"], x["e"]).alias("e"),
            x["v"].alias("v"),
        ),
    )
    live = F.filter(spans, lambda x: x["e"].isNull() | (x["e"] > x["s"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & last["e"].eqNullSafe(x["s"]) & last["v"].eqNullSafe(x["v"])
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(x)))

    folded = days.select(*keys, live.alias("_l")).filter(F.size("_l") > 0).select(*keys, F.aggregate("_l", F.filter("_l", lambda x: F.lit(False)), step).alias("_v"))
    return folded.select(*keys, F.explode("_v").alias("_x")).select(*keys, F.col("_x.s").alias("valid_from"), F.col("_x.e").alias("valid_to"), F.col("_x.v").alias("value"))


def fact_history(facts: DataFrame) -> DataFrame:
    """History believed now: ``(entity, relation, valid_from, valid_to, value)`` of raw facts.

    Given-up statements (``expired_at`` set) do not count; entities compare without case and outer
    blanks; dates are cut to the day. Repeated rows change nothing.
    """
    rows = facts.filter(F.col("expired_at").isNull()).select(
        F.upper(F.trim(F.col("entity"))).alias("entity"),
        "relation",
        as_day(F.col("valid_from")).alias("_s"),
        as_day(F.col("valid_to")).alias("_e"),
        "created_at",
        "fact_id",
        value_key(F.col("value_json")).alias("_val"),
    )
    return versions(rows, ["entity", "relation"], "_s", "_val", own_end="_e", rank=["created_at", "fact_id"])
