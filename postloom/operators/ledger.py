"""Bi-temporal facts: current belief, as-of reads, history of beliefs."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "relation"]


def current(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Current belief of an assertion log: ``(entity, relation, value, valid_from, valid_to)``.

    The last assertion of a start wins, intervals of a key follow each other and the last is open.
    The choice is a partial aggregate, so only one row per key and start meets the window.
    """
    won = log.filter(F.col("valid_from").isNotNull()).groupBy(*KEYS, "valid_from").agg(F.max(F.struct(F.col(seq), F.col("value"))).alias("m"))
    w = Window.partitionBy(*KEYS).orderBy("valid_from")
    return won.select(*KEYS, F.col("m.value").alias("value"), "valid_from", F.lead("valid_from").over(w).alias("valid_to"))


def as_of(questions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Value in force at each question's day: ``questions`` is (entity, relation, day)."""
    b = beliefs.select(*KEYS, "value", "valid_from", "valid_to")
    return questions.join(b, KEYS).filter((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))


def _believe(carry: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        live: dict[str, int] = {}
        starts: list[str] = []

        def put(vf, vt, value, at, more):
            out.append([key[0], key[1], value, vf, vt, at, None, *more])
            live[vf] = len(out) - 1

        def end(vf, at):
            out[live[vf]][6] = at

        for vf, value, at, *more in rows.sort_values("seq", kind="stable")[["valid_from", "value", "created_at", *carry]].itertuples(index=False):
            i = bisect_left(starts, vf)
            if i < len(starts) and starts[i] == vf:
                vt = out[live[vf]][4]
                end(vf, at)
            else:
                insort(starts, vf)
                vt = starts[i + 1] if i + 1 < len(starts) else None
                if i:
                    before = starts[i - 1]
                    old = out[live[before]]
                    end(before, at)
                    put(before, vf, old[2], at, old[7:])
            put(vf, vt, value, at, more)
        return pd.DataFrame(out, columns=["entity", "relation", "value", "valid_from", "valid_to", "created_at", "expired_at", *carry])

    return run


def belief_history(log: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every belief ever held: an assertion opens a row, and a change of its interval another.

    ``log`` is (entity, relation, value, valid_from, created_at, seq) and the string columns
    ``carry``, which follow the value (its source, say). Each assertion touches
    itself and the belief before it, so a key yields at most two rows per assertion; keys are
    folded one by one, with no text in the rows.
    """
    carry = carry or []
    schema = "entity string, relation string, value string, valid_from string, valid_to string, created_at string, expired_at string" + "".join(f", {c} string" for c in carry)
    return log.filter("valid_from is not null").select(*KEYS, "value", "valid_from", "created_at", "seq", *carry).groupBy(*KEYS).applyInPandas(_believe(carry), schema)


def backfill(inputs: DataFrame) -> DataFrame:
    """Assertions numbered in order of their start, then of their place in the input."""
    return inputs.withColumn("seq", F.row_number().over(Window.partitionBy(*KEYS).orderBy("valid_from", "seq")))
