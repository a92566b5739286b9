"""Graph traversal, evidence bookkeeping and joins over conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import graph as G
from ..registry import query
from ..session import table

CONTENTS_SQL = "contents AS (SELECT conv_id AS graph, 'e' || turn AS content, turn AS place, role, text FROM conversations)"
LINKS_SQL = f"{CONTENTS_SQL}, links AS (SELECT DISTINCT graph, unnest(CASE WHEN len(c) > 0 THEN c ELSE ['Unknown'] END) AS cue, role AS tag, content, place FROM (SELECT *, regexp_extract_all(text, '\\b[A-Z][a-z]{{2,}}') AS c FROM contents))"


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.concat(F.lit("e"), "turn").alias("content"), F.col("turn").alias("place"), "role", "text")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_links(_contents(spark, sf_dir), G.capitalised(F.col("text")), F.col("role"))


@query(f"WITH {LINKS_SQL} SELECT graph, cue, tag, content FROM links")
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"""WITH {LINKS_SQL}, active AS (SELECT DISTINCT graph, cue FROM links WHERE place = 0)
SELECT DISTINCT graph, content FROM links JOIN active USING (graph, cue) WHERE tag IN (SELECT l.tag FROM links l JOIN active a USING (graph, cue) WHERE l.graph = links.graph) AND tag <> 'system' AND place <> 0""")
def ctc_traverse_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents reached from the first turn's cues, without system turns and the first turn itself."""
    links = _links(spark, sf_dir)
    first = links.where(F.col("content") == "e0")
    active = first.select("graph", "cue").distinct()
    tags = G.forward_tags(links, active)
    excluded = tags.where(F.col("tag") == "system")
    return G.forward_contents(links, active, tags, excluded, first.select("graph", "content").distinct())


@query(f"WITH {LINKS_SQL} SELECT DISTINCT graph, cue, tag FROM links")
def ctc_traverse_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues and tags behind the contents of each graph."""
    return G.reverse(_links(spark, sf_dir), _contents(spark, sf_dir).select("graph", "content"))


@query("SELECT conv_id AS graph, 't' || (turn // 4) AS topic, turn AS episode FROM conversations")
def topic_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each topic's list, here four turns of a conversation."""
    topics = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("graph"), F.concat(F.lit("t"), F.floor(F.col("turn") / 4)).alias("topic")).agg(F.collect_list("turn").alias("topic_links"))
    return topics.select("graph", "topic", F.explode("topic_links").alias("episode"))


@query(f"""WITH {LINKS_SQL}, cues AS (SELECT graph, cue, min(place) AS seq FROM links GROUP BY 1, 2),
q AS (SELECT graph, content AS question, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM contents),
m AS (SELECT q.graph, question, cue, seq, len(list_distinct(regexp_extract_all(lower(cue), '[a-z0-9]+'))) AS n_tokens FROM q JOIN cues ON q.graph = cues.graph
  WHERE len(list_filter(list_distinct(regexp_extract_all(lower(cue), '[a-z0-9]+')), lambda x: NOT list_contains(toks, x))) = 0 OR contains(t, lower(cue)))
SELECT graph, question, cue, n_tokens::INT AS n_tokens, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY graph, question ORDER BY n_tokens DESC, seq, cue) AS rank FROM m) WHERE rank <= 25""")
def cue_subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = _contents(spark, sf_dir)
    cues = _links(spark, sf_dir).join(contents.select("graph", "content", "place"), ["graph", "content"]).groupBy("graph", "cue").agg(F.min("place").alias("seq"))
    questions = contents.select("graph", F.col("content").alias("question"), "text")
    return G.match_cues(questions, cues)


@query(f"WITH {CONTENTS_SQL} SELECT a.graph, a.content, b.content AS neighbour FROM contents a JOIN contents b ON a.graph = b.graph AND abs(a.place - b.place) BETWEEN 1 AND 2")
def contiguity_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(_contents(spark, sf_dir).select("graph", "content", "place"), 2)


@query("""
WITH ids AS (SELECT text, max_by(doc_id, doc_id) AS doc_id FROM documents WHERE doc_id % 3 > 0 GROUP BY text)
SELECT d.doc_id AS row_id, coalesce(ids.doc_id::VARCHAR, '?') AS evidence_id FROM documents d LEFT JOIN ids USING (text)""")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids found again by text: the last of equal texts wins, "?" where there is none. Texts meet by digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("_d"))
    ids = docs.where("doc_id % 3 > 0").groupBy("_d").agg(F.max("doc_id").alias("id"))
    return docs.join(ids, "_d", "left").select(F.col("doc_id").alias("row_id"), F.coalesce(F.col("id").cast("string"), F.lit("?")).alias("evidence_id"))


@query("""
WITH probes AS (SELECT item_id, left(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 200) AS probe FROM benchmark),
ctx AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS c FROM documents)
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM probes JOIN ctx ON contains(c, probe) WHERE length(probe) > 20 GROUP BY item_id""")
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose first 200 normalised characters (the rule's probe) stand in a document."""
    probes = table(spark, sf_dir, "benchmark").select("item_id", F.substring(X.squeezed(F.col("text")), 1, 200).alias("probe")).where(F.length("probe") > 20)
    docs = table(spark, sf_dir, "documents").select("doc_id", X.squeezed(F.col("text")).alias("c"))
    return G.holding(probes, docs).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
SELECT l.doc_id, l.quality, d.source, d.doc_id IS NULL AS missing FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) d USING (doc_id)""")
def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id", "source", F.lit(True).alias("_there"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select("doc_id", "quality", "source", F.col("_there").isNull().alias("missing"))


@query("""
WITH gold AS (SELECT conv_id, turn, left(text, 50) AS g FROM conversations), ev AS (SELECT conv_id, text AS e FROM conversations WHERE role <> 'user')
SELECT gold.conv_id, gold.turn, max(CASE WHEN contains(e, g) THEN 1 ELSE 0 END)::INT AS hit FROM gold JOIN ev USING (conv_id) GROUP BY 1, 2""")
def gold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passages (all turns) found in their conversation's evidence (the replies) by their first 50 characters, which
    is the test's own rule, inserted dates removed."""
    c = table(spark, sf_dir, "conversations")
    gold = c.select("conv_id", "turn", F.substring("text", 1, 50).alias("g"))
    evidence = c.where("role <> 'user'").select("conv_id", X.without_dates(F.col("text")).alias("e"))
    return gold.join(evidence, "conv_id").groupBy("conv_id", "turn").agg(F.max(F.contains("e", "g").cast("int")).alias("hit"))


@query("""
SELECT user_id, a, b, b - a AS diff FROM (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS a, round(avg(value) FILTER (event_type = 'view'), 6) AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions (users) that have both arms."""
    arm = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)
    both = table(spark, sf_dir, "events").groupBy("user_id").agg(arm("click").alias("a"), arm("view").alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").withColumn("diff", F.col("b") - F.col("a"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "lang")


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def checkpoint_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key; the maximum combines before the shuffle, no group is sorted."""
    last = F.max(F.struct("ts", "event_id", "value")).alias("x")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.event_id", "x.value")


@query(f"""WITH {CONTENTS_SQL}, k AS (SELECT graph, content, place, text, row_number() OVER (PARTITION BY graph, text ORDER BY place) AS r FROM contents)
SELECT graph, content, row_number() OVER (PARTITION BY graph ORDER BY place)::INT AS pos FROM k WHERE r = 1""")
def evidence_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in order with repeated texts dropped; ids stay in step."""
    first = _contents(spark, sf_dir).groupBy("graph", F.sha2("text", 256).alias("_d")).agg(F.min(F.struct("place", "content")).alias("x"))
    return first.select("graph", "x.content", F.row_number().over(Window.partitionBy("graph").orderBy("x.place")).alias("pos"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1)
SELECT c_mktsegment, count(*) AS orders, round(sum(r), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN s ON l_orderkey = o_orderkey GROUP BY 1""")
def rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals are summed before the joins, so that lineitem is shuffled once and small."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    big = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_anti").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_f"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import top

    return top(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "r")


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running FROM events")
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("running"))
