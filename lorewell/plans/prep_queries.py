"""Training-data preparation and benchmark bookkeeping over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..registry import query
from ..session import table
from ..sources import readers
from .text_queries import BM25_STOP_SQL


@query("""
SELECT a.conv_id, a.turn AS target, count(b.turn) AS context_turns, md5(coalesce(string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn), '')) AS context_md5, a.text AS answer
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.role <> 'system' WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn, a.text""")
def supervised_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn with all turns before it; one grouping, then slices of its array."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = turns.select("conv_id", "t", F.explode(F.filter("t", lambda x: x["role"] == "assistant")).alias("a"))
    before = F.filter("t", lambda x: (x["turn"] < F.col("a.turn")) & (x["role"] != "system"))
    lines = F.transform(before, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.select("conv_id", F.col("a.turn").alias("target"), F.size(before).cast("long").alias("context_turns"), F.md5(F.array_join(lines, "\n")).alias("context_md5"), F.col("a.text").alias("answer"))


@query("""
SELECT conv_id, count(*) FILTER (role = 'system') AS system_turns, min(CASE WHEN role <> 'system' THEN turn END) AS first_turn, sum(length(text))::BIGINT AS length, list(turn ORDER BY turn)[-3:] AS tail FROM conversations GROUP BY 1""")
def chat_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prefix, length and the last three turns kept by tail truncation."""
    turns = F.array_sort(F.collect_list("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("system_turns"), F.min(F.when(F.col("role") != "system", F.col("turn"))).alias("first_turn"), F.sum(F.length("text")).alias("length"), turns.alias("t")).select("conv_id", "system_turns", "first_turn", "length", F.when(F.size("t") > 3, F.slice("t", -3, 3)).otherwise(F.col("t")).alias("tail"))


@query("""
WITH h AS (SELECT event_id, ('0x' || left(md5('3|' || event_id), 8))::BIGINT % 1000 AS p FROM events)
SELECT event_id, CASE WHEN p < 100 THEN 'no_state' WHEN p < 300 THEN 'state_only' ELSE 'both' END AS mode FROM h""")
def training_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws by hash: a tenth without state, a fifth with state alone."""
    p = F.conv(F.substring(F.md5(F.concat(F.lit("3|"), "event_id")), 1, 8), 16, 10).cast("long") % 1000
    return table(spark, sf_dir, "events").select("event_id", F.when(p < 100, "no_state").when(p < 300, "state_only").otherwise("both").alias("mode"))


@query("""
SELECT question, i, a[i + 1] AS answer, coalesce(m[i + 1], 'none') AS meta FROM (SELECT question, a, a2[:2] AS m, unnest(range(len(a)))::INT AS i FROM (
  SELECT l_orderkey AS question, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS a, list(l_linestatus ORDER BY l_linenumber, l_returnflag, l_linestatus) AS a2 FROM lineitem GROUP BY 1))""")
def zipped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays row by row, shorter metadata filled up."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("a"))
    rows = a.select("question", F.transform("a", lambda x: x["l_returnflag"]).alias("answer"), F.slice(F.transform("a", lambda x: x["l_linestatus"]), 1, 2).alias("meta"))
    return readers.zipped_questions(rows, "question", ["answer", "meta"], "none")


@query("""
SELECT item_id, item_id <= (SELECT max(item_id) FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT (SELECT least(greatest(1, round_even(count(*) * 0.1::DOUBLE, 0)), count(*) - 1)::INT FROM benchmark))) AS bootstrap FROM benchmark""")
def bootstrap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bootstrap_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 0.1)


@query("""
WITH w AS (SELECT DISTINCT substr(md5(text), 1, 16) AS doc_key FROM documents), b AS (SELECT substr(md5(text), 1, 16) AS doc_key FROM documents WHERE doc_id % 3 = 0)
SELECT doc_key FROM w WHERE doc_key NOT IN (SELECT doc_key FROM b)""")
def missing_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an index yet, by content key."""
    d = table(spark, sf_dir, "documents").select("doc_id", readers.doc_key(F.col("text")).alias("doc_key"))
    return readers.missing_keys(d, d.where("doc_id % 3 = 0"))


MAPPING = (("accurate", "qa"), ("learning", "icl"), ("long", "summary"), ("conflict", "fact"))


@query("""
WITH n AS (SELECT DISTINCT source || '_' || ['accurate_qa', 'icl_learning_x', 'plain', 'long_summary_y'][(doc_id % 4) + 1] AS name FROM documents)
SELECT name, CASE WHEN contains(name, 'accurate') AND contains(name, 'qa') THEN 0 WHEN contains(name, 'learning') AND contains(name, 'icl') THEN 1 WHEN contains(name, 'long') AND contains(name, 'summary') THEN 2 WHEN contains(name, 'conflict') AND contains(name, 'fact') THEN 3 END AS template FROM n""")
def template_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mapping all of whose patterns occur in the dataset's name."""
    kinds = F.array(*[F.lit(x) for x in ("accurate_qa", "icl_learning_x", "plain", "long_summary_y")])
    n = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_"), F.get(kinds, (F.col("doc_id") % 4).cast("int"))).alias("name")).distinct()
    found = F.lit(None).cast("int")
    for i, patterns in reversed(list(enumerate(MAPPING))):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.col("name").contains(p)
        found = F.when(hit, i).otherwise(found)
    return n.select("name", found.alias("template"))


@query("""
WITH e AS (SELECT conv_id, '[Evidence ' || (turn + 1) || '] ' || text AS line, turn FROM conversations), b AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS block FROM e GROUP BY 1)
SELECT conv_id, CASE WHEN length(block) > 400 THEN right(block, 400) ELSE block END AS block FROM b""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered evidence joined; beyond the budget the tail stays."""
    line = F.concat(F.lit("[Evidence "), F.col("turn") + 1, F.lit("] "), "text")
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))
    return b.select("conv_id", F.when(F.length("block") > 400, F.substring("block", -400, 400)).otherwise(F.col("block")).alias("block"))


@query("""
SELECT page_id, length(t)::INT AS chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as plain text."""
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("chars"), F.md5(t).alias("text_md5"))


@query("""
SELECT lang, count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS usable, count(*) FILTER (quality IS NULL) AS skipped, round(avg(CASE WHEN quality = 1 AND NOT contains(text, 'the') THEN 1.0::DOUBLE WHEN quality = 1 THEN 0 END), 6) AS hit_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def build_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.contains("text", F.lit("the")).alias("the")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("usable"), F.count_if(F.col("quality").isNull()).alias("skipped"), F.round(F.avg(F.when(F.col("quality") == 1, (~F.col("the")).cast("double"))), 6).alias("hit_rate"))


@query("""
SELECT user_id, event_id, n // 3 AS shard, n % 3 = 0 AS first FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS n FROM events)""")
def balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by falling cost, three to a shard."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n")).select("user_id", "event_id", F.floor(F.col("n") / 3).alias("shard"), (F.col("n") % 3 == 0).alias("first"))


@query(f"""
WITH x AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\\b[A-Z][a-z]{{2,}}') AS c, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({BM25_STOP_SQL})) AS t FROM conversations)
SELECT conv_id, turn, coalesce(list_reverse_sort(list_transform(t, lambda w: {{'n': length(w), 'w': w}}))[1].w, 'Mention') AS tag, unnest(list_distinct(list_append(c, coalesce(role, 'Unknown')))) AS cue FROM x""")
def extracted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and cues of every turn by the rule-based extractor."""
    from ..functions import models

    c = table(spark, sf_dir, "conversations").withColumn("x", models.extract(F.col("text"), F.col("role")))
    return c.select("conv_id", "turn", "x.tag", F.explode("x.cues").alias("cue"))


@query("""
WITH t AS (SELECT DISTINCT text FROM conversations), w AS (SELECT text, ('0x' || left(md5(w), 8))::BIGINT AS h FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t)),
s AS (SELECT text, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY 1, 2),
g AS (SELECT a.text, a.d, coalesce(x, 0) AS x FROM (SELECT text, unnest(range(64)) AS d FROM t) a LEFT JOIN s ON s.text = a.text AND s.d = a.d), n AS (SELECT text, sqrt(sum(x * x)) AS n FROM g GROUP BY 1),
v AS (SELECT g.text, list(round(CASE WHEN n > 1e-9 THEN x / n ELSE x END, 9) ORDER BY d) AS v FROM g JOIN n USING (text) GROUP BY 1)
SELECT conv_id, turn, v, floor(len(regexp_extract_all(text, '\\S+')) * 1.35::DOUBLE)::BIGINT AS tokens FROM conversations JOIN v USING (text)""")
def encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and hashed bag-of-words vectors; each distinct text is encoded once."""
    from ..functions import models

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    vectors = c.select("text").distinct().withColumn("v", models.encode(F.col("text")))
    return c.join(vectors, "text").select("conv_id", "turn", F.transform("v", lambda x: F.round(x, 9)).alias("v"), X.approx_tokens(F.col("text")).alias("tokens"))
