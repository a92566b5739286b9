"""Steps of the retrieve-and-reflect loop. Replies of a model are composed from the turns that stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import loop as L
from ..operators import ranking as R
from ..registry import query
from ..session import table

_JSON_SQL = "CASE WHEN regexp_matches(reply, '(?s)\\{.*\\}') AND json_valid(regexp_extract(reply, '(?s)\\{.*\\}')) THEN regexp_extract(reply, '(?s)\\{.*\\}') END"


def _case(k: Column, replies: list[Column]) -> Column:
    out = replies[-1]
    for i, r in reversed(list(enumerate(replies[:-1]))):
        out = F.when(k == i, r).otherwise(out)
    return out


@query(f"""
WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{"actions": ["cue_to_tag"]}}' WHEN 1 THEN 'Sure: {{"actions": [], "exclude_tags": ["user", "' || role || '"]}} done' WHEN 2 THEN 'no object ' || text ELSE '{{"actions": ["content_to_cue_tag", "cue_to_tag"], "exclude_tags": "none"}}' END AS reply FROM conversations),
j AS (SELECT *, {_JSON_SQL} AS j FROM r), a AS (SELECT *, CASE WHEN json_type(j, '$.actions') = 'ARRAY' THEN from_json(json_extract(j, '$.actions'), '["VARCHAR"]') ELSE [] END AS a, CASE WHEN json_type(j, '$.exclude_tags') = 'ARRAY' THEN from_json(json_extract(j, '$.exclude_tags'), '["VARCHAR"]') ELSE [] END AS e FROM j)
SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN array_to_string(a, '+') ELSE 'cue_to_tag+tag_to_content' END AS actions, array_to_string(e, ',') AS excluded, j IS NOT NULL AS parsed FROM a""")
def action_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions that a reply names, the default pair where it names none."""
    reply = _case(F.col("turn") % 4, [F.lit('{"actions": ["cue_to_tag"]}'), F.concat(F.lit('Sure: {"actions": [], "exclude_tags": ["user", "'), "role", F.lit('"]} done')), F.concat(F.lit("no object "), "text"), F.lit('{"actions": ["content_to_cue_tag", "cue_to_tag"], "exclude_tags": "none"}')])
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", L.chosen_actions(reply).alias("s"))
    return s.select("conv_id", "turn", F.array_join("s.actions", "+").alias("actions"), F.array_join("s.excluded", ",").alias("excluded"), "s.parsed")


@query(f"""
WITH c AS (SELECT conv_id, list('e' || turn ORDER BY turn) AS ids, list('e' || turn ORDER BY length(text) DESC, turn) AS ranked FROM conversations GROUP BY 1),
r AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN '{{"kept_content_ids": "ALL"}}' WHEN 1 THEN 'cut off {{"kept_content_ids": ["e1"' WHEN 2 THEN '{{"kept_content_ids": ["what was said", "e99"]}}' WHEN 3 THEN 'Here: {{"kept_content_ids": ["e1", "e77", "e0"], "new_gaps": []}}' ELSE '{{"resolved_gaps": ["x"]}}' END AS reply FROM c),
j AS (SELECT *, {_JSON_SQL} AS j FROM r), k AS (SELECT *, CASE WHEN json_type(j, '$.kept_content_ids') = 'ARRAY' THEN list_filter(from_json(json_extract(j, '$.kept_content_ids'), '["VARCHAR"]'), lambda x: list_contains(ids, x)) ELSE [] END AS named, json_extract_string(j, '$.kept_content_ids') AS raw FROM j),
m AS (SELECT *, CASE WHEN j IS NULL THEN 'fail_open_parse_failed' WHEN raw IS NULL OR raw = 'ALL' THEN 'fail_open_all' WHEN len(named) = 0 THEN 'fail_open_invalid_ids' ELSE 'explicit' END AS mode FROM k),
f AS (SELECT *, CASE WHEN mode = 'explicit' THEN named ELSE ranked[:6] END AS kept FROM m)
SELECT conv_id, array_to_string(kept, ',') AS kept, mode, len(ids)::INT AS n_candidates, len(kept)::INT AS n_kept, length(reply)::INT AS raw_len FROM f""")
def routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a round's candidates and why: an explicit list, or the best six."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("e"), "turn").alias("id"), F.length("text").alias("n"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id")))["id"].alias("ids"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "turn", "id")))["id"].alias("ranked"))
    reply = _case(F.col("conv_id") % 5, [F.lit('{"kept_content_ids": "ALL"}'), F.lit('cut off {"kept_content_ids": ["e1"'), F.lit('{"kept_content_ids": ["what was said", "e99"]}'), F.lit('Here: {"kept_content_ids": ["e1", "e77", "e0"], "new_gaps": []}'), F.lit('{"resolved_gaps": ["x"]}')])
    s = lists.select("conv_id", L.routed(reply, F.col("ids"), F.col("ids"), F.col("ranked")).alias("s"))
    return s.select("conv_id", F.array_join("s.kept", ",").alias("kept"), "s.mode", "s.n_candidates", "s.n_kept", "s.raw_len")


@query("""
WITH g AS (SELECT conv_id, turn, text AS q, ['who', 'when', role] AS gaps, CASE turn % 3 WHEN 0 THEN ['when', role, 'who'] WHEN 1 THEN ['who'] ELSE [] END AS resolved, CASE turn % 3 WHEN 1 THEN ['where', 'when'] ELSE [] END AS new, CASE WHEN turn % 2 = 1 THEN 'look for ' || role END AS following, turn % 4 AS stuck, turn + 1 AS iteration FROM conversations),
a AS (SELECT *, list_filter(gaps, lambda x: NOT list_contains(resolved, x)) AS rest FROM g), b AS (SELECT *, list_concat(rest, list_filter(new, lambda x: NOT list_contains(rest, x))) AS after FROM a)
SELECT conv_id, turn, array_to_string(after, ',') AS gaps, CASE WHEN len(after) = 0 THEN md5(q) WHEN following IS NOT NULL THEN md5(q || ' | ' || following) ELSE md5('as it was') END AS next_md5, CASE WHEN iteration >= 5 OR len(after) = 0 OR stuck >= 2 THEN 'answer' ELSE 'retrieve' END AS step FROM b""")
def gap_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps after a reply, the question they lead to, and whether the search goes on."""
    words = lambda *w: F.array(*[F.lit(x) if x != "role" else F.col("role") for x in w])
    none = F.array().cast("array<string>")
    k = F.col("turn") % 3
    after = L.gaps_after(words("who", "when", "role"), F.when(k == 0, words("when", "role", "who")).when(k == 1, words("who")).otherwise(none), F.when(k == 1, words("where", "when")).otherwise(none))
    g = table(spark, sf_dir, "conversations").select("*", after.alias("after"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("look for "), "role")).alias("following"))
    return g.select("conv_id", "turn", F.array_join("after", ",").alias("gaps"), F.md5(L.next_question(F.col("text"), F.lit("as it was"), F.col("after"), F.col("following"))).alias("next_md5"), L.next_step(F.col("turn") + 1, F.col("after"), F.col("turn") % 4).alias("step"))


_SIMS_SQL = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS question, a.label AS own, b.vec_id AS item, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
hits AS (SELECT question, item, sim FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, item) AS r FROM s WHERE own = label) WHERE r <= 25 AND sim >= 0.25)"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all vectors, questions, hits): a question's hits are the nearest items of its label, as behind its cues."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("v").alias("q_vec"), F.col("label").alias("own"))
    items = e.select(F.col("vec_id").alias("item"), F.col("v").alias("vec"), "label")
    of = R.nearest(q.select("question", "q_vec"), items, L.ROUND, least=0.25, part=F.col("label"))
    hits = of.join(q.select("question", F.col("own").cast("string").alias("part")), ["question", "part"]).select("question", "item", "sim")
    return items, q.select("question", "q_vec"), hits


@query(f"""
WITH {_SIMS_SQL}, n AS (SELECT q.question, count(hits.item) AS n FROM (SELECT DISTINCT question FROM s) q LEFT JOIN hits USING (question) GROUP BY 1),
f AS (SELECT s.question, s.item, row_number() OVER (PARTITION BY s.question ORDER BY s.sim DESC, s.item) AS r, n FROM s JOIN n USING (question) ANTI JOIN hits ON hits.question = s.question AND hits.item = s.item WHERE n < 8)
SELECT question, item, 'cue' AS channel FROM hits UNION ALL SELECT question, item, 'topup' FROM f WHERE r <= least(10, 25 - n)""")
def topped_up_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin round is filled up with the most similar items that it did not find."""
    items, q, hits = _hits(spark, sf_dir)
    # hits take no more than TOPUP_BELOW of the best
    return L.topped_up(hits, R.nearest(q, items, L.TOPUP_ADD + L.TOPUP_BELOW))


@query(f"""
WITH {_SIMS_SQL}, seeds AS (SELECT question, item FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, item) AS r FROM hits) WHERE r <= 8),
b AS (SELECT DISTINCT s.question, s.item, s.sim FROM seeds d JOIN s ON s.question = d.question AND abs(s.item - d.item) = 1 ANTI JOIN hits ON hits.question = s.question AND hits.item = s.item),
c AS (SELECT question, item FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, item) AS r FROM b) WHERE r <= 6),
nn AS (SELECT seed, item FROM (SELECT x.item AS seed, y.vec_id AS item, row_number() OVER (PARTITION BY x.item ORDER BY round(list_cosine_similarity(z.v, y.v), 9) DESC, y.vec_id) AS r FROM (SELECT DISTINCT item FROM seeds) x JOIN e z ON z.vec_id = x.item JOIN e y ON y.vec_id <> x.item) WHERE r <= 5),
p AS (SELECT DISTINCT s.question, s.item, s.sim FROM seeds d JOIN nn ON nn.seed = d.item JOIN s ON s.question = d.question AND s.item = nn.item ANTI JOIN hits ON hits.question = s.question AND hits.item = s.item ANTI JOIN c ON c.question = s.question AND c.item = s.item),
k AS (SELECT question, item FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, item) AS r FROM p) WHERE r <= 10)
SELECT question, item, 'contiguity' AS channel FROM c UNION ALL SELECT question, item, 'knn' FROM k""")
def expansion_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies beside the best hits in time, and what is most like them."""
    items, q, hits = _hits(spark, sf_dir)
    seeds = R.top(hits, "question", [F.desc("sim"), F.asc("item")], L.SEEDS).select("question", "item")
    ids = items.select(F.col("item").alias("neighbour"), F.col("vec").alias("n_vec"))
    beside = seeds.select("question", "item", F.explode(F.array(F.col("item") - 1, F.col("item") + 1)).alias("neighbour"))
    alike = R.nearest(seeds.select(F.col("item").alias("question")).distinct().join(items.select(F.col("item").alias("question"), F.col("vec").alias("q_vec")), "question"), items, L.KNN)
    near = seeds.join(alike.select(F.col("question").alias("item"), F.col("item").alias("neighbour")), "item").select("question", "item", "neighbour")

    def relevant(pairs: DataFrame) -> DataFrame:
        both = pairs.where("neighbour <> question").join(ids, "neighbour").join(q, "question")
        return both.select("question", "item", "neighbour", F.round(V.cosine(F.col("q_vec"), F.col("n_vec")), 9).alias("sim"))

    return L.expanded(hits, relevant(beside), relevant(near))


@query("""
SELECT conv_id, turn + 1 AS iteration, CASE WHEN turn % 2 = 0 THEN 'Planning' ELSE 'Reflection' END AS module,
  length(text) || ' new content node(s)' || CASE WHEN turn % 3 > 0 THEN ' (+' || (turn % 3) || ' contiguity)' ELSE '' END || CASE WHEN turn % 4 > 0 THEN ' (+' || (turn % 4) || ' knn)' ELSE '' END || CASE WHEN turn % 5 > 0 THEN ' (+' || (turn % 5) || ' semantic top-up)' ELSE '' END AS found FROM conversations""")
def search_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step with what it found, channel by channel."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", (t + 1).alias("iteration"), F.when(t % 2 == 0, "Planning").otherwise("Reflection").alias("module"), L.found_summary(F.length("text"), t % 3, t % 4, t % 5).alias("found"))


@query("""
WITH r AS (SELECT user_id AS question, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round, event_id, event_type, value FROM events),
k AS (SELECT question, round, (value * 40)::BIGINT AS tokens, CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE 1 END AS added, event_type = 'signup' AS answered FROM r WHERE round <= 5),
w AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY question ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(lag(added) OVER (PARTITION BY question ORDER BY round), 1) AS last FROM k),
s AS (SELECT *, CASE WHEN before > 6000 THEN 'token_budget' WHEN added = 0 AND last = 0 THEN 'graph_exhausted' WHEN answered THEN 'route_answer' WHEN round = 5 THEN 'max_iterations' END AS reason FROM w),
f AS (SELECT question, min(round) FILTER (reason IS NOT NULL) AS at, max(round) AS last FROM s GROUP BY 1)
SELECT f.question, coalesce(s.round - CASE WHEN s.reason = 'token_budget' THEN 1 ELSE 0 END, f.last)::INT AS rounds, coalesce(s.reason, 'max_iterations') AS stop_reason FROM f LEFT JOIN s ON s.question = f.question AND s.round = f.at""")
def bridge_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why and after how many rounds a search ends; a user's events stand in for its rounds."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("round", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    tokens = F.round(F.col("value") * 40).cast("long")
    rounds = e.select(F.col("user_id").alias("question"), "round", tokens.alias("tokens"), F.when(F.col("event_type").isin("view", "error"), 0).otherwise(1).alias("added"), (F.col("event_type") == "signup").alias("answered"))
    return L.stopped(rounds)


@query("""
WITH s AS (SELECT conv_id, turn, text, (conv_id * 5 + turn * 7) % 16 AS score, role FROM conversations), ev AS (SELECT conv_id, string_agg(text, '; ' ORDER BY turn) AS ev FROM conversations WHERE role = 'assistant' GROUP BY 1),
k AS (SELECT *, CASE WHEN score > 10 THEN 'good' WHEN score < 5 THEN 'bad' END AS quality FROM s WHERE turn % 4 <> 3)
SELECT conv_id AS question, turn AS step, module, quality, md5(CASE WHEN module = 'Planning' THEN text ELSE text || ' | evidence so far: ' || coalesce(ev, '') END) AS condition_md5 FROM k LEFT JOIN ev USING (conv_id) CROSS JOIN (SELECT unnest(['Planning', 'Reflection']) AS module) WHERE quality IS NOT NULL""")
def bank_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiences of both modules from scored steps; answer steps and middling scores make none."""
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("evidence"))
    decision = F.when(F.col("turn") % 4 == 3, "answer").otherwise("retrieve")
    steps = c.join(said, "conv_id", "left").select(F.col("conv_id").alias("question"), F.col("text").alias("query"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.col("turn").alias("step"), decision.alias("decision"), ((F.col("conv_id") * 5 + F.col("turn") * 7) % 16).alias("score"))
    return L.bank_entries(steps).select("question", "step", "module", "quality", F.md5("condition").alias("condition_md5"))


@query("""
WITH t AS (SELECT a.conv_id, a.turn, string_split_regex(trim(a.text), '\\s+') AS x, string_split_regex(trim(b.text), '\\s+') AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 2),
p AS (SELECT *, list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]) AS d FROM t)
SELECT conv_id, turn, (CASE WHEN len(d) > 0 THEN d[1] - 1 ELSE least(len(x), len(y)) END)::INT AS shared, CASE WHEN len(d) = 0 AND len(x) >= len(y) THEN 'extend' ELSE 'reset' END AS act FROM p""")
def prefix_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leading tokens a new history shares with the one that is held: it is extended if that is all of it."""
    c = table(spark, sf_dir, "conversations")
    words = lambda t: F.split(F.trim(t), r"\s+")
    held = c.select("conv_id", (F.col("turn") + 2).alias("turn"), words(F.col("text")).alias("y"))
    both = c.select("conv_id", "turn", words(F.col("text")).alias("x")).join(held, ["conv_id", "turn"])
    shorter = F.least(F.size("x"), F.size("y"))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at("x", i) != F.element_at("y", i))
    first = F.when(F.size(differs) > 0, differs[0] - 1).otherwise(shorter)
    return both.select("conv_id", "turn", first.alias("shared"), F.when((first == F.size("y")) & (F.size("x") >= F.size("y")), "extend").otherwise("reset").alias("act"))


@query("""
WITH q AS (SELECT item_id, text FROM benchmark), w AS (SELECT item_id, len(regexp_extract_all(text, '\\S+')) AS n FROM q)
SELECT q.item_id, md5('Question: ' || text || chr(10) || 'Evidence:' || chr(10) || '- ' || left(text, 40) || chr(10) || '- ' || n) AS prompt_md5 FROM q JOIN w USING (item_id)""")
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answering step's prompt: the question and its evidence as bullets."""
    from ..functions.prompts import answer_prompt

    b = table(spark, sf_dir, "benchmark")
    evidence = F.array(F.substring("text", 1, 40), X.word_count(F.col("text")).cast("string"))
    return b.select("item_id", F.md5(answer_prompt(F.col("text"), evidence)).alias("prompt_md5"))
