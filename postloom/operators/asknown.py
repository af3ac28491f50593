"""Events combined with the attributes valid at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.skew import salted_lookup
from postloom.session import cut


def period_of(c):
    """Start of the month of a timestamp, as a timestamp."""
    return F.date_trunc("month", c)


def period_states(holdings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Snapshot and change log per (key, period): ``(key, period, snapshot, changes)``.

    ``holdings`` is (key, holder, valid_from, valid_to) with timestamps, NULL meaning open;
    ``wanted`` is the distinct (key, period) pairs that events ask for. ``snapshot`` lists the
    holdings in force when the period begins, ``changes`` those that begin later within it; both
    as struct(start, opened, closed, holder), ``start`` ordering open starts first.

    A holding appears in the periods it overlaps and events ask for only. Of
    holdings with the same start and end within a period only one can ever win, and of those in
    force from before the period with the same end only the latest started can; both are chosen
    by a partial aggregate, so an array is bounded by the distinct instants of a period even if
    one key owns a third of all holdings.
    """
    first = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    span = wanted.agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))  # one row
    valid = holdings.filter(F.col("key").isNotNull() & (F.col("valid_to").isNull() | F.col("valid_from").isNull() | (F.col("valid_from") < F.col("valid_to"))))
    months = (
        valid.join(F.broadcast(span))
        .withColumn("_a", F.greatest(period_of(F.coalesce("valid_from", "_lo")), F.col("_lo")))
        .withColumn("_b", F.least(period_of(F.coalesce("valid_to", "_hi")), F.col("_hi")))
        .filter("_a <= _b")
        .withColumn("period", F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))))
        .join(wanted, ["key", "period"], "left_semi")
    )
    before = F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("period"))
    ends_in = F.when(F.col("valid_to") < F.add_months("period", 1), F.col("valid_to"))
    best = (
        months.withColumn("_before", before)
        .withColumn("closed", ends_in)
        .groupBy("key", "period", "_before", F.when(~before, F.col("valid_from")).alias("opened"), "closed")
        # latest start wins; ties go to the smallest holder
        .agg(F.max(F.coalesce("valid_from", first)).alias("start"), F.min(F.struct((-F.unix_micros(F.coalesce("valid_from", first))).alias("s"), F.col("holder").alias("holder"))).alias("_best"))
        .select("key", "period", "_before", F.struct("start", "opened", "closed", F.col("_best.holder").alias("holder")).alias("h"))
    )
    return best.groupBy("key", "period").agg(
        F.array_sort(F.collect_list(F.when(F.col("_before"), F.col("h")))).alias("snapshot"),
        F.array_sort(F.collect_list(F.when(~F.col("_before"), F.col("h")))).alias("changes"),
    )


def attributes_at(events: DataFrame, holdings: DataFrame, key: str, at: str, holder: str = "holder") -> DataFrame:
    """Each event with the holder of its ``key`` at its time ``at``; events nobody answers drop out.

    A holding counts from its start inclusive to its end exclusive; if several do, the one with
    the latest start wins (an open start is earliest, remaining ties go to the smallest holder).
    Events join the snapshot of the period before them and replay only the changes up to their own
    instant; nothing that begins later is ever seen. Events with NULL key or time have no holder.
    All columns of the events come out; one already named like ``holder`` is replaced.
    """
    # events travel as one struct, so none of their columns can clash with those used here
    keyed = events.select(F.struct(*[F.col(c) for c in events.columns]).alias("event"), F.col(key).alias("key"), F.col(at).alias("at")).filter("key is not null and at is not null").withColumn("period", period_of(F.col("at")))
    keyed = cut(keyed)  # read for the periods asked for, for hot keys and for the join
    wanted = keyed.select("key", "period").distinct()
    place = F.concat_ws("\u0001", F.col("key").cast("string"), F.col("period").cast("string"))
    states = period_states(holdings, wanted).select(place.alias("place"), "snapshot", "changes")
    joined = salted_lookup(keyed.select("event", "at", place.alias("place")), states, "place", "inner")
    replay = F.filter(F.col("changes"), lambda c: c["opened"] <= F.col("at"))
    alive = F.filter(F.concat(F.col("snapshot"), replay), lambda h: h["closed"].isNull() | (h["closed"] > F.col("at")))
    ranked = F.array_sort(F.transform(alive, lambda h: F.struct((-F.unix_micros(h["start"])).alias("s"), h["holder"].alias("holder"))))
    found = joined.withColumn("found", F.try_element_at(ranked, F.lit(1))["holder"]).filter("found is not null")
    return found.select(*[F.col("event")[c].alias(c) for c in events.columns if c != holder], F.col("found").alias(holder))


def instant(c):
    """ISO date or date-time text as a timestamp in UTC; a date means its midnight."""
    text = F.trim(c)
    return F.try_to_timestamp(F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text))


def senders_at(messages: DataFrame, people: DataFrame) -> DataFrame:
    """``(message_id, person_id)``: who held from_address when the message was sent."""
    held = people.select("person_id", F.explode("addresses").alias("a")).select(
        F.lower(F.trim("a.address")).alias("key"),
        F.col("person_id").alias("holder"),
        instant(F.col("a.from_date")).alias("valid_from"),
        instant(F.col("a.to_date")).alias("valid_to"),
    ).distinct()
    events = messages.select("message_id", F.lower(F.trim("from_address")).alias("key"), instant(F.col("sent_at")).alias("at")).filter("key is not null and key <> '' and at is not null").distinct()
    return attributes_at(events, held, "key", "at", "person_id").select("message_id", "person_id")
