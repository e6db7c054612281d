"""The handover machine over a stream of messages, with the state of each conversation kept by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.functions.patterns import CONFIDENTIAL
from scriptorium.operators.sessions import CONFIRMED

STATE, OUTPUT = "state string, reason string", "conv_id long, turn long, state string, reason string"
_TRIGGER = re.compile(CONFIDENTIAL, re.IGNORECASE)


def step(state: str, reason: str, text: str) -> tuple[str, str]:
    """The state after one user message."""
    if state == "handed_over":
        return state, reason
    if state == "pending":
        return ("handed_over", reason) if text.strip().lower() in CONFIRMED else ("cleared", "")
    found = sorted({m.lower() for m in _TRIGGER.findall(text)})
    return ("pending", ", ".join(found)) if found else ("none", "")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current, reason = state.get if state.exists else ("none", "")
    rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
    out = []
    for turn, text in zip(rows["turn"], rows["text"], strict=True):
        current, reason = step(current, reason, text or "")
        out.append((key[0], turn, current, reason))
    state.update((current, reason))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "state", "reason"])


def handover_stream(messages: DataFrame) -> DataFrame:
    """A streaming DataFrame of conv_id, turn, state, reason; messages of a micro-batch are taken by turn."""
    users = messages.where("role = 'user'").select("conv_id", "turn", "text")
    return users.groupBy("conv_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
