"""Texts that models are asked with, and texts that nodes and memories are shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import asks_when, asks_yes_no

GROUNDED = "Answer from the evidence alone, in as few words as possible, about the person the question names."
NO_REFUSAL = "Give the most likely answer; do not say that there is none."
MAY_REFUSE = "Say that it is not mentioned if the evidence does not tell."
DATED_TIME = "The evidence begins with its date: count from there and answer with a date."
PLAIN_TIME = "Answer with a date or a length of time."
YES_NO = "Begin with yes or no."


def answer_prompt(question: Column, evidence: Column) -> Column:
    """The question and its evidence, a bullet each."""
    return F.concat(F.lit("Question: "), question, F.lit("\nEvidence:\n"), F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e)), "\n"))


def qa_prompt(question: Column, system: Column | None = None, dated: Column | None = None, may_refuse: bool = False, guided: bool = True) -> Column:
    """An instruction block by the question's shape, then the question. Not ``guided``: the question alone, below the
    system's instruction if there is one."""
    base = F.concat(F.lit("Question: "), question, F.lit("\nShort answer:"))
    if guided:
        timing = F.when(asks_when(question), F.when(F.lit(False) if dated is None else dated, DATED_TIME).otherwise(PLAIN_TIME))
        base = F.concat_ws("\n", F.lit(GROUNDED), F.lit(MAY_REFUSE if may_refuse else NO_REFUSAL), timing, F.when(asks_yes_no(question), YES_NO), base)
    return base if system is None else F.concat_ws("\n\n", system, base)


def filled(template: str, **fields: Column) -> Column:
    """A template with {names} replaced by columns; null as nothing."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def memorised(chunk: Column, stamp: Column) -> Column:
    """A piece of context as it is given to a memory to keep, with a fixed time instead of the clock's."""
    return F.concat(F.lit("At "), stamp, F.lit(" this was read; keep it in mind:\n"), chunk)


def fact_text(content: Column, temporal: Column, spatial: Column) -> Column:
    """content (Time: ...; Location: ...), without what is empty."""
    some = lambda x: F.nullif(x, F.lit(""))
    extra = F.concat_ws("; ", F.concat(F.lit("Time: "), some(temporal)), F.concat(F.lit("Location: "), some(spatial)))
    return F.when(extra == "", content).otherwise(F.concat(content, F.lit(" ("), extra, F.lit(")")))


def titled(title: Column, summary: Column) -> Column:
    """An episode's or a topic's text."""
    return F.when(F.coalesce(title, F.lit("")) == "", summary).otherwise(F.concat(title, F.lit(": "), summary))


def transcript(turns: Column) -> Column:
    """Lines "speaker: text" of an ordered array of (speaker, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")


def first_of(*replies: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(r, F.lit("")) for r in replies], F.lit(""))
