"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. It is rendered on successive prefixes of the turns;
where the output with one turn more starts with the output before, what was added is that turn's
span. A template that changes what it has already written is detected there, with the length of the
part that still agrees, and no spans are given. Where the text stands within a turn's span is found the
same way: the turn is rendered with two other texts, and what their outputs share at either end is not
text.

Whole conversations are rendered, whatever their length. Only a template that its author declares to be
``concatenative`` (every turn's output depends on that turn alone) is rendered in parts of bounded
length, so that a very long conversation spreads over tasks. The declaration is tested: a part rendered
as a whole must be what its short stretches of prefixes made, and the same behind the last turn of the
part before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_bytes, placed

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
#: Where the template is concatenative: turns of a part, and of a stretch that is rendered by its prefixes.
PART_TURNS, STRETCH_TURNS = 256, 32


def concatenative(template: Template) -> Template:
    """Declare that a template writes each turn from that turn alone, so that parts of a conversation may be rendered apart."""
    template.concatenative = True
    return template


def escape(text: str) -> str:
    """Put the escape mark into every control string; ``unescape`` undoes it exactly."""
    return re.sub(r"<\|(im_start|im_end|esc)\|>", lambda m: f"<|esc|>{m[1]}|>", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|esc\|>(im_start|im_end|esc|nl)\|>", lambda m: "\n" if m[1] == "nl" else f"<|{m[1]}|>", text)


@concatenative
def chat_template(turns: Sequence[Turn]) -> str:
    """Every turn as start mark, role, new line, text, end mark, new line; texts and roles escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), '<|esc|>nl|>')}\n{escape(text)}{END}\n" for role, text in turns)


@dataclass
class Rendering:
    text: str
    #: Begin and end of every turn in ``text``; none if a turn changed earlier output.
    spans: list[tuple[int, int]]
    #: The first turn whose addition changed earlier output, and how much of that still agreed.
    rewritten_at: int | None = None
    agreed: int | None = None


def _agreement(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def render(turns: Sequence[Turn], template: Template = chat_template) -> Rendering:
    """Render successive prefixes of ``turns`` and locate each turn by comparing consecutive outputs."""
    before, spans = template([]), []
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return Rendering(template(turns), [], k, _agreement(before, now))
        spans.append((len(before), len(now)))
        before = now
    return Rendering(before, spans)


#: Two texts that no template has marks of and that differ in their only character.
PROBES = "\ue0f0", "\ue0f1"


def text_place(turns: Sequence[Turn], k: int, begin: int, stop: int, whole: str, template: Template = chat_template) -> tuple[int, int] | None:
    """Begin and end of turn k's text in ``whole``; None if the template's other output depends on the text."""
    apart = getattr(template, "concatenative", False)
    earlier, role = ([], turns[k][0]) if apart else (list(turns[:k]), turns[k][0])
    before = 0 if apart else begin
    one, two = (template([*earlier, (role, probe)])[before:] for probe in PROBES)
    head = _agreement(one, two)
    tail = min(_agreement(one[::-1], two[::-1]), len(one) - head, len(two) - head)
    span = whole[begin:stop]
    if head == len(one) or len(span) < head + tail or span[:head] != one[:head] or (tail and span[-tail:] != one[-tail:]):
        return None
    return begin + head, stop - tail


def render_part(turns: Sequence[Turn], before: Turn | None, template: Template) -> tuple[Rendering, bool]:
    """A part of a conversation from stretches of prefixes, and whether the declared template keeps its word on it."""
    text, spans, rewritten = "", [], None
    for at in range(0, len(turns), STRETCH_TURNS):
        made = render(turns[at : at + STRETCH_TURNS], template)
        if made.rewritten_at is not None and rewritten is None:
            rewritten = Rendering("", [], at + made.rewritten_at, len(text) + made.agreed)
        spans += [(len(text) + b, len(text) + e) for b, e in made.spans]
        text += made.text
    whole = template(turns)
    holds = not template([]) and whole == text
    if before is not None:
        holds = holds and template([before, *turns]) == template([before]) + whole
    if rewritten is not None:
        return Rendering(whole, [], rewritten.rewritten_at, rewritten.agreed), False
    return Rendering(text, spans), holds


def parse_turn(text: str) -> Turn:
    """Role and text of one turn as ``chat_template`` writes it."""
    role, _, rest = text.removeprefix(START).partition("\n")
    return unescape(role), unescape(rest.removesuffix(f"{END}\n"))


FORMATTED = (
    "conv_id string, chunk long, formatted string, rewritten_at long, joins boolean, "
    "spans array<struct<begin:long,stop:long,role:string,loss_begin:long,loss_stop:long>>"
)


def format_conversations(turns: DataFrame, template: Template = chat_template, learn: str = "assistant", part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each conversation, or part of one: its output, each turn's span and loss mask, any rewrite.

    Conversations are rendered whole unless the template is declared ``concatenative``; then a row holds at
    most ``part_turns`` turns, ``chunk`` orders the rows, and ``joins`` is false where the template's output
    isn't that of its parts. The mask of a turn to learn is where its text stands, none (-1) if the
    template's marks depend on the text. Turns are ordered by turn, role and text, and counted in that
    order: missing and repeated turn numbers change nothing. A null text or role is empty, a null turn
    comes first; rows without conversation are one conversation. An empty table gives no rows; other
    columns are ignored.
    """

    apart = getattr(template, "concatenative", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, chunk, rows in zip(batch["conv_id"], batch["chunk"], batch["turns"], strict=True):
                said = [(r["role"], r["text"]) for r in rows if not r["lead"]]
                before = [(r["role"], r["text"]) for r in rows if r["lead"]]
                made, holds = render_part(said, before[0] if before else None, template) if apart else (render(said, template), True)
                spans = []
                for k, ((begin, stop), (role, _)) in enumerate(zip(made.spans, said, strict=False)):
                    mask = (role == learn and text_place(said, k, begin, stop, made.text, template)) or (-1, -1)
                    spans.append({"begin": begin, "stop": stop, "role": role, "loss_begin": mask[0], "loss_stop": mask[1]})
                rewritten = -1 if made.rewritten_at is None else made.rewritten_at
                out.append((conv_id, chunk, made.text, rewritten, holds, spans))
            yield pd.DataFrame(out, columns=["conv_id", "chunk", "formatted", "rewritten_at", "joins", "spans"])

    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if apart:
        # The last turn of a part is in the next one too, in front of its own; parts of one conversation follow each other.
        counted = placed(rows, "conv_id", "turn", "role", "text")
        part, last = F.floor(F.col("place") / part_turns).cast("long"), F.col("place") % part_turns == part_turns - 1
        own, lead = F.struct(part.alias("chunk"), F.lit(False).alias("lead")), F.struct((part + 1).alias("chunk"), F.lit(True).alias("lead"))
        rows = counted.withColumn("to", F.explode(F.when(last, F.array(own, lead)).otherwise(F.array(own)))).select("conv_id", "to.chunk", "place", "to.lead", "role", "text")
        turn = F.struct("place", "lead", "role", "text")
    else:
        rows = rows.withColumns({"chunk": F.lit(0).cast("long"), "lead": F.lit(False)})
        turn = F.struct("turn", "role", "text", "lead")
    grouped = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.min("lead").alias("only_lead"))
    bounded_bytes(turns.sparkSession)
    return grouped.where("NOT only_lead").select("conv_id", "chunk", "turns").mapInPandas(run, FORMATTED)


DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of what its outputs say when read again.

    A conversation's chunks pass one by one; only counts and digest states are kept between them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, state = None, None

        def closed() -> pd.DataFrame:
            n, every, chars, loss, size, changed = state
            return pd.DataFrame([(open_id[0], n, every.hexdigest(), chars, loss.hexdigest(), size, changed)], columns=[f.split()[0] for f in DIGESTS.split(", ")])

        for batch in batches:
            for conv_id, text, spans, rewritten, whole in zip(*(batch[c] for c in ("conv_id", "formatted", "spans", "rewritten_at", "joins")), strict=True):
                if open_id != (conv_id,):
                    if open_id is not None:
                        yield closed()
                    open_id, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for s in spans:
                    role, said = parse_turn(text[s["begin"] : s["stop"]])
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if s["loss_begin"] >= 0:
                        learnt = unescape(text[s["loss_begin"] : s["loss_stop"]])
                        state[2] += len(learnt)
                        state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] |= rewritten >= 0 or not whole
        if open_id is not None:
            yield closed()

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return dealt.mapInPandas(run, DIGESTS).withColumn("conv_id", F.col("conv_id").cast("long"))
