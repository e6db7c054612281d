"""State over the turns of a conversation, in batch: language, role, structure mode, handover.

Windows and folds are per conversation. The streaming form of the fold is in ``scriptorium.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptorium.operators.guardrails import language_of, role_of, triggers

CONFIRMED = ["yes", "y", "ja", "confirm", "confirmed"]


def so_far() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)


def language_drift(messages: DataFrame, preference: str = "en", detected: Column | None = None) -> DataFrame:
    """User messages with the language in use: the last one that was detected, else the preference."""
    users = messages.where("role = 'user'")
    found = detected if detected is not None else language_of(F.coalesce(F.col("text"), F.lit("")))
    return users.withColumn("detected", found).withColumn("effective", F.coalesce(F.last("detected", ignorenulls=True).over(so_far()), F.lit(preference)))


def structure_mode(messages: DataFrame) -> DataFrame:
    """User messages with role_known and structure_only: from the second one without a role until one is named."""
    users = messages.where("role = 'user'").withColumn("named", role_of(F.coalesce(F.col("text"), F.lit(""))))
    users = users.withColumn("role_known", F.max(F.col("named").isNotNull()).over(so_far()))
    missed = F.sum((~F.col("role_known")).cast("int")).over(so_far())
    return users.withColumn("structure_only", ~F.col("role_known") & (missed > 1))


def handover_states(messages: DataFrame) -> DataFrame:
    """conv_id, turn, state, reason of user messages: none, pending, then handed_over (final) or cleared.

    The state depends on every message before, so each conversation's messages are folded in order.
    """
    step = F.struct("turn", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("said"), F.array_join(triggers(F.coalesce(F.col("text"), F.lit(""))), ", ").alias("reason"))
    turns = messages.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    kind = "array<struct<turn:bigint,state:string,reason:string>>"

    def fold(seen: Column, s: Column) -> Column:
        last = F.get(seen, F.size(seen) - 1)
        before, reason = F.coalesce(last["state"], F.lit("none")), F.coalesce(last["reason"], F.lit(""))
        state = (
            F.when(before == "handed_over", "handed_over")
            .when((before == "pending") & s["said"].isin(CONFIRMED), "handed_over")
            .when(before == "pending", "cleared")
            .when(s["reason"] != "", "pending")
            .otherwise("none")
        )
        kept = F.when(state == "pending", s["reason"]).when(state == "handed_over", reason).otherwise("")
        return F.array_append(seen, F.struct(s["turn"].alias("turn"), state.alias("state"), kept.alias("reason")))

    folded = turns.select("conv_id", F.explode(F.aggregate("steps", F.array().cast(kind), fold)).alias("s"))
    return folded.select("conv_id", "s.turn", "s.state", "s.reason")


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, transcript, turns: messages in order, each after its role."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("turns"))
