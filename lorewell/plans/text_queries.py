"""Row-level text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..session import table

STOP_SQL = ", ".join(f"'{w}'" for w in X.STOPWORDS)
BM25_STOP_SQL = ", ".join(f"'{w}'" for w in X.BM25_STOPWORDS)
RAW_SQL = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
CONTENT_SQL = f"list_filter({RAW_SQL}, lambda t: t NOT IN ({STOP_SQL}))"


@query(f"""
SELECT doc_id, len({RAW_SQL})::INT AS n_raw, len({CONTENT_SQL})::INT AS n_content,
       md5(array_to_string(list_sort({CONTENT_SQL}), ' ')) AS tokens_md5
FROM documents""")
def tokenise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = X.content_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.raw_tokens(F.col("text"))).alias("n_raw"), F.size(content).alias("n_content"), F.md5(F.array_join(F.sort_array(content), " ")).alias("tokens_md5"))


@query(f"""
SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({BM25_STOP_SQL})) AS t FROM documents)""")
def index_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.index_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("""
SELECT conv_id, token, count(*) AS n FROM (
  SELECT conv_id, unnest(list_filter(list_transform(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: t <> '')) AS token
  FROM conversations) GROUP BY conv_id, token""")
def keyword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(X.bag_tokens(F.col("text"))).alias("token")).groupBy("conv_id", "token").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, floor(len(regexp_extract_all(text, '\\S+')) * 1.35::DOUBLE)::BIGINT AS approx_tokens,
       md5(substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 200)) AS fingerprint
FROM documents""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("approx_tokens"), X.fingerprint(F.col("text")).alias("fingerprint"))


@query("""
SELECT min(doc_id) AS doc_id, md5(substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 200)) AS fingerprint, count(*) AS copies
FROM documents GROUP BY 2""")
def dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of the rows with one fingerprint; counts combine before the shuffle."""
    return table(spark, sf_dir, "documents").groupBy(X.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_PUNCT = "[!-/:-@\\[-`{-~]"


def _drop(words: str, expr: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({expr}, '\\s+'), lambda t: t NOT IN ({words}, '')), ' ')"


@query(f"""
SELECT conv_id, turn,
  {_drop("''", "regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")} AS plain,
  {_drop("'a', 'an', 'the', 'and'", f"regexp_replace(lower(replace(text, ',', '')), '{_PUNCT}', '', 'g')")} AS dialogue,
  {_drop("'a', 'an', 'the'", f"regexp_replace(lower(text), '{_PUNCT}', '', 'g')")} AS document
FROM conversations""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer_plain(t).alias("plain"), X.answer_dialogue(t).alias("dialogue"), X.answer_document(t).alias("document"))


@query("""
WITH q AS (SELECT conv_id, turn, ['When did ', 'Is it true that ', 'How many days until ', 'Did they pick tea or ', 'What is '][(conv_id + turn) % 5 + 1] || text AS question FROM conversations)
SELECT conv_id, turn,
  regexp_matches(question, '(?i)^when\\b|\\bhow\\s+(?:long|old)\\b|\\bhow\\s+many\\s+(?:days?|weeks?|months?|years?)\\b|^(?:what|which)\\s+(?:date|year|month|week|day)\\b') AS timing,
  regexp_matches(question, '(?i)^\\s*(?:[^,?]{0,60},\\s*)?(?:is|are|was|were|does|do|did|has|have|had|can|could|will|would|should|shall|may|might|must)\\b')
    AND NOT regexp_matches(question, '(?i)\\bor\\b') AS yes_no
FROM q""")
def question_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(*[F.lit(x) for x in ("When did ", "Is it true that ", "How many days until ", "Did they pick tea or ", "What is ")])
    q = F.concat(F.get(starts, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.asks_when(q).alias("timing"), X.asks_yes_no(q).alias("yes_no"))


@query("""
WITH r AS (SELECT event_id, ['"answer": "C"', 'Final answer: b', 'The correct answer is **D** indeed', 'A.', 'because of X' || chr(10) || 'B) yes', 'no letter here'][event_id % 6 + 1] AS reply FROM events)
SELECT event_id, ['C', 'B', 'D', 'A', 'B', ''][event_id % 6 + 1] AS letter FROM r""")
def choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = F.array(*[F.lit(x) for x in ('"answer": "C"', "Final answer: b", "The correct answer is **D** indeed", "A.", "because of X\nB) yes", "no letter here")])
    return table(spark, sf_dir, "events").select("event_id", X.choice_letter(F.get(replies, (F.col("event_id") % 6).cast("int"))).alias("letter"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tea' WHEN 1 THEN 'coffee' WHEN 2 THEN 'No information available' ELSE 'plain ' || event_type END AS answer FROM events""")
def canonical_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "(a) tea").when(k == 1, "\n B) coffee, I think").when(k == 2, "It is not mentioned.").otherwise(F.concat(F.lit("Answer: plain "), "event_type", F.lit("\nbecause")))
    return e.select("event_id", X.canonical_answer(raw, F.when(k == 3, 4).otherwise(5), F.lit("tea"), F.lit("coffee")).alias("answer"))


def _vote_sql() -> str:
    votes = ", ".join(f"{{'n': len(list_filter(t, lambda w: w IN ({', '.join(repr(w) for w in words.split())}))), 'o': {-i}, 'l': '{lang}'}}" for i, (lang, words) in enumerate(X.LATIN_WORDS.items()))
    return f"list_sort([{votes}], 'DESC')[1]"


@query(f"""
SELECT doc_id, CASE WHEN v.n > 0 THEN v.l ELSE 'en' END AS language FROM (
  SELECT doc_id, {_vote_sql()} AS v FROM (SELECT doc_id, regexp_extract_all(translate(lower(text), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents))""")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.language(F.col("text")).alias("language"))


@query("""
SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda t: trim(t, ' ' || chr(10) || chr(9) || chr(13))), lambda t: t <> '') AS s FROM documents)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 200) || chr(10) || '...' || chr(10) || right(text, 400) END AS clip FROM documents""")
def context_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clipped(F.col("text"), 600).alias("clip"))


@query("""
WITH t AS (SELECT conv_id, turn, '[8 May, 2023] ' || upper(left(role, 1)) || substr(role, 2) || ': ' || text || ' (see D' || conv_id || ':' || turn || '; D1:3)' AS line FROM conversations)
SELECT conv_id, turn, upper(left(role, 1)) || substr(role, 2) AS speaker, true AS dated, conv_id || ':' || turn || ';1:3' AS gold
FROM conversations JOIN t USING (conv_id, turn)""")
def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render turns with date and speaker, then read speaker, date prefix and evidence references back."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(X.display_text(F.concat(F.initcap("role"), F.lit(": "), "text"), F.lit("8 May, 2023")), F.lit(" (see D"), "conv_id", F.lit(":"), "turn", F.lit("; D1:3)"))
    rendered = c.select("conv_id", "turn", line.alias("line"))
    return rendered.select("conv_id", "turn", X.speaker(F.col("line")).alias("speaker"), X.is_dated(F.col("line")).alias("dated"), F.array_join(X.gold_ids(F.col("line")), ";").alias("gold"))


@query("""
SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of raw, fenced and chatty replies: the raw text, a fenced block, then the widest braces."""
    e = table(spark, sf_dir, "events")
    way = F.col("event_id") % 3
    reply = F.when(way == 0, F.col("props")).when(way == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {}"))).otherwise(F.concat(F.lit("I think "), "props", F.lit(" fits.")))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    read = lambda c: F.from_json(c, "k long").getField("k")
    return e.select("event_id", F.coalesce(read(reply), read(fenced), read(braces)).alias("k"))


def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct index tokens of conversations and their stems."""
    words = table(spark, sf_dir, "conversations").select(F.explode(X.index_tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", F.get(X.stemmed(F.array("token")), F.lit(0)).alias("stem"))


query()(stem_words)


@query("""
SELECT item_id, n, alias FROM (
  SELECT item_id, n, alias, row_number() OVER (PARTITION BY item_id, norm ORDER BY n) AS r FROM (
    SELECT item_id, n, alias, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(alias), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> ''), ' ') AS norm FROM (
      SELECT item_id, unnest([0, 1, 2, 3]) AS n, unnest([w, upper(w), w || '!', w || ' extra']) AS alias FROM (SELECT item_id, split_part(text, ' ', 1) AS w FROM benchmark)))) WHERE r = 1""")
def alias_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split_part("text", F.lit(" "), F.lit(1))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(w, X.simple_upper(w), F.concat(w, F.lit("!")), F.concat(w, F.lit(" extra")))).alias("n", "alias"))
    return b.groupBy("item_id", X.answer_plain(F.col("alias")).alias("norm")).agg(F.min(F.struct("n", "alias")).alias("x")).select("item_id", "x.n", "x.alias")
