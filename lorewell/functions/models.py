"""The model boundary: what a language model, encoder or reranker would answer, as pluggable functions with
deterministic stand-ins, so that every dataflow around them can run and be tested offline."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import content_tokens, index_tokens

DIMS = 64


def hashed_vector(text: str, dims: int = DIMS) -> np.ndarray:
    """Bag of words hashed to a unit vector, equal in every process: 32 bits of a word's digest say where it counts, the
    highest of them with which sign."""
    v = np.zeros(dims)
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % dims] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return v / n if n > 1e-9 else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def encode(text: pd.Series) -> pd.Series:
    memo: dict[str, np.ndarray] = {}
    return text.map(lambda t: memo.setdefault(t or "", hashed_vector(t or "")))


def rerank_score(question: Column, passage: Column) -> Column:
    """Overlap of content tokens, the stand-in for a cross encoder's yes-no difference."""
    return F.size(F.array_intersect(content_tokens(question), content_tokens(passage))).cast("double")


def extract(text: Column, speaker: Column) -> Column:
    """struct(tag, cues): capitalised words and the speaker as cues, the longest content word as tag."""
    cues = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}"), F.lit(0)), F.array(F.coalesce(speaker, F.lit("Unknown")))))
    words = F.transform(index_tokens(text), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.struct(F.coalesce(F.array_max(words)["w"], F.lit("Mention")).alias("tag"), cues.alias("cues"))


def summary(text: Column) -> Column:
    return F.trim(F.substring(text, 1, 300))


def judged(reply: Column) -> Column:
    """A judge's verdict: a JSON object's "correct", or words that mean yes."""
    read = F.from_json(reply, "correct string")["correct"]
    word = F.lower(F.trim(F.coalesce(read, reply)))
    return F.coalesce(word.isin("true", "yes", "correct", "1"), F.lit(False))


def by_rules(system: str, user: str) -> str:
    """What stands in for a language model. Asked for actions it takes the forward ones; asked to route it keeps the new
    contents that share a content word with the question, names the question's words that no evidence has as gaps, and
    searches for those."""
    if system != "routing":
        return json.dumps({"actions": ["cue_to_tag", "tag_to_content"]})
    said = json.loads(user)
    words = lambda t: [w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) > 3]
    asked = words(said["question"])
    kept = [c["id"] for c in said["candidates"] if set(words(c["text"])) & set(asked)]
    held = {w for e in [*said["evidence"], *(c["text"] for c in said["candidates"])] for w in words(e)}
    gaps = [w for w in dict.fromkeys(asked) if w not in held]
    return json.dumps({"kept_content_ids": kept or "ALL", "resolved_gaps": [g for g in said["gaps"] if g not in gaps], "new_gaps": gaps, "next_query": " ".join(gaps)})


@dataclass
class Model:
    """chat(system, user) -> reply, by rules unless another function is given."""

    chat: Callable[[str, str], str] = by_rules

    def reply(self, system: str, user: Column) -> Column:
        """The replies to a column of prompts; an empty one where the model fails, which must not end a run."""
        chat = self.chat

        def safely(prompt: str | None) -> str:
            try:
                return chat(system, prompt or "")
            except Exception:  # noqa: BLE001  whatever a model raises
                return ""

        @F.pandas_udf(T.StringType())
        def replies(prompts: pd.Series) -> pd.Series:
            return prompts.map(safely)

        return replies(user)

    def ask(self, system: str, user: str) -> dict:
        """One reply's JSON object, or an empty one whatever goes wrong."""
        try:
            found = re.search(r"\{.*\}", self.chat(system, user), re.DOTALL)
            got = json.loads(found[0]) if found else {}
        except Exception:  # noqa: BLE001  a model's failure must not end a run
            return {}
        return got if isinstance(got, dict) else {}
