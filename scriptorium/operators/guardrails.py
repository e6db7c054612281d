"""Checks on single messages of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import every, has
from scriptorium.functions.vocabulary import ROLES

MIN_DETECTION_CHARS = 15
#: Words by which the default scorer tells two languages apart. A detector may replace it.
ENGLISH = "the and of to in that is it for with this was are be on not have you".split()
GERMAN = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine".split()


def triggers(text: Column) -> Column:
    """Distinct confidential words, lowered and sorted."""
    return F.array_sort(F.array_distinct(F.transform(every(text, P.CONFIDENTIAL), F.lower)))


def scores_something(text: Column) -> Column:
    return has(text, P.SCORES)


def asks_rewrite(text: Column) -> Column:
    return has(text, P.REWRITE_ASKED)


def gives_rewrite(text: Column) -> Column:
    return has(text, P.REWRITE_GIVEN)


def is_affirmative(text: Column) -> Column:
    return has(F.trim(text), P.AFFIRMATIVE)


def role_of(text: Column) -> Column:
    """The category of the first listed keyword that a text contains."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(word), category) for category, words in ROLES for word in words])


def language_of(text: Column) -> Column:
    """``en`` or ``de`` by stop words; null for short texts, ties and anything else."""
    words = F.split(F.lower(text), r"(?U)[^\w]+")
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    en, de = count(ENGLISH), count(GERMAN)
    return F.when(F.char_length(F.trim(text)) < MIN_DETECTION_CHARS, None).when((en >= 2) & (en > 2 * de), "en").when((de >= 2) & (de > 2 * en), "de")


def message_checks(messages: DataFrame) -> DataFrame:
    """``messages`` with triggers, scored, rewrite_asked, rewrite_given and role_named."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return messages.select(
        "*", triggers(text).alias("triggers"), scores_something(text).alias("scored"), asks_rewrite(text).alias("rewrite_asked"),
        gives_rewrite(text).alias("rewrite_given"), role_of(text).alias("role_named"),
    )
