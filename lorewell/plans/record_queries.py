"""Bookkeeping of benchmark runs over conversations, events and documents that stand in for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prompts as P
from ..functions import records as C
from ..functions import scores as M
from ..functions import text as X
from ..operators import ranking as R
from ..registry import query
from ..session import table
from .score_queries import KEY, PAIRS_SQL, SHARED_SQL


@query("""
WITH r AS (SELECT *, CASE turn % 4 WHEN 0 THEN '{"response": "said ' || turn || '"}' WHEN 1 THEN '{"response": "", "text": "told ' || turn || '"}' WHEN 2 THEN '{}' ELSE 'broken' END AS reply FROM conversations),
l AS (SELECT conv_id, arg_max(text, turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN 'said ' || turn WHEN 1 THEN 'told ' || turn ELSE coalesce(last, '') END) AS prediction_md5 FROM r LEFT JOIN l USING (conv_id)""")
def prediction_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from reply objects, else from the session's last reply."""
    c = table(spark, sf_dir, "conversations")
    told = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    k, n = F.col("turn") % 4, F.col("turn").cast("string")
    reply = F.when(k == 0, F.concat(F.lit('{"response": "said '), n, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"response": "", "text": "told '), n, F.lit('"}'))).when(k == 2, "{}").otherwise("broken")
    return c.join(told, "conv_id").select("conv_id", "turn", F.md5(C.prediction(reply, F.col("messages"))).alias("prediction_md5"))


_SOURCE_SQL = "CASE turn % 3 WHEN 0 THEN 'infbench_sum_eng_shots2' WHEN 1 THEN 'detective_qa' ELSE 'ruler_' || turn END"


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, turn, pt, gt, p, g, {SHARED_SQL.format(p='p', g='g')}::DOUBLE AS s, {_SOURCE_SQL} AS source FROM pairs),
f AS (SELECT *, CASE WHEN len(p) = 0 OR len(g) = 0 OR s = 0 THEN 0 ELSE 2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)) END AS f1, array_to_string(p, ' ') AS np, array_to_string(g, ' ') AS ng FROM s),
k AS (SELECT *, contains(ng, np) OR contains(np, ng) AS correct, starts_with(source, 'infbench_sum') AS by_f1 FROM f)
SELECT conv_id, turn, source, CASE WHEN by_f1 THEN 'F1-Score' ELSE 'Accuracy' END AS metric, round(CASE WHEN by_f1 THEN round(f1, 4) ELSE correct::INT END, 6)::DOUBLE AS primary_score, round(f1, 4)::DOUBLE AS f1, length(gt)::INT AS context_chars, CASE WHEN length(gt) > 215 THEN 220 ELSE length(gt) END::INT AS prompt_context_chars FROM k""")
def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per prediction: its scores, the one that its source reports, and context sizes before and after
    clipping to 215 characters and a marker."""
    from .score_queries import _pairs

    pairs = _pairs(spark, sf_dir)
    f1 = M.scored(pairs, KEY, both_empty=0.0).select(*KEY, "f1")
    n = F.col("turn") % 3
    rows = pairs.join(f1, KEY).withColumn("source", F.when(n == 0, "infbench_sum_eng_shots2").when(n == 1, "detective_qa").otherwise(F.concat(F.lit("ruler_"), "turn")))
    np, ng, metric = F.array_join("p", " "), F.array_join("g", " "), C.primary_metric(F.col("source"))
    correct = F.contains(ng, np) | F.contains(np, ng)
    clipped = F.length(X.clipped(F.col("gt"), 215))
    return rows.select(*KEY, "source", C.display_name(metric).alias("metric"), F.round(C.primary_score(metric, correct, F.col("f1"), F.lit(None).cast("double")), 6).alias("primary_score"), F.round("f1", 4).alias("f1"), F.length("gt").alias("context_chars"), clipped.alias("prompt_context_chars"))


@query("""
WITH l AS (SELECT l_orderkey AS q, list(l_partkey % 40 ORDER BY l_linenumber, l_partkey % 40) AS p, list(DISTINCT l_suppkey % 40) AS w FROM lineitem GROUP BY 1)
SELECT q, round(len(list_filter(list_distinct(p[:1]), lambda x: list_contains(w, x)))::DOUBLE / len(w), 6) AS recall_1, round(len(list_filter(list_distinct(p[:5]), lambda x: list_contains(w, x)))::DOUBLE / len(w), 6) AS recall_5 FROM l""")
def recommendation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of wanted items among the first predicted ones."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 40).alias("p"))))["p"].alias("p"), F.collect_set(F.col("l_suppkey") % 40).alias("w"))  # noqa: E741
    return l.select("q", *[F.round(C.recall_at(F.col("p"), F.col("w"), k), 6).alias(f"recall_{k}") for k in (1, 5)])


@query("""
WITH r AS (SELECT conv_id, turn, text AS response, ['punctuation:no_comma', 'keywords:existence', 'length_constraints:number_words', 'startend:end_checker', 'other:kind'] AS kinds, [NULL, role, '20', '.'] AS a FROM conversations),
v AS (SELECT *, list_transform(string_split(response, chr(10)), lambda x: x) AS l FROM r),
w AS (SELECT *, [response, trim(array_to_string(l[2:], chr(10)), ' '), trim(array_to_string(l[:len(l) - 1], chr(10)), ' '), trim(array_to_string(l[2:len(l) - 1], chr(10)), ' ')] AS cuts FROM v),
z AS (SELECT conv_id, turn, list_concat(cuts, list_transform(cuts, lambda x: replace(x, '*', ''))) AS vs, role FROM w JOIN conversations USING (conv_id, turn)),
x AS (SELECT conv_id, turn, list_transform(vs, lambda s: [trim(s, ' ') <> '' AND NOT contains(s, ','), trim(s, ' ') <> '' AND contains(lower(s), lower(role)), trim(s, ' ') <> '' AND len(regexp_extract_all(s, '\\S+')) >= 20, trim(s, ' ') <> '' AND ends_with(trim(s, ' '), '.'), false]) AS f FROM z)
SELECT conv_id, turn, 5 AS n, len(list_filter(f[1], lambda b: b)) AS strict, len(list_filter(range(1, 6), lambda i: len(list_filter(f, lambda y: y[i])) > 0)) AS loose FROM x""")
def instruction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that a response follows as it is, and in one of its variants; arguments are filled up with nulls."""
    kinds = F.array(*map(F.lit, ("punctuation:no_comma", "keywords:existence", "length_constraints:number_words", "startend:end_checker", "other:kind")))
    arguments = F.array(F.lit(None).cast("string"), F.col("role"), F.lit("20"), F.lit("."))
    return C.checked(table(spark, sf_dir, "conversations").select(*KEY, F.col("text").alias("response"), kinds.alias("kinds"), arguments.alias("arguments")), KEY)


@query("""
SELECT o_orderkey % 50 AS run, round(avg(o_totalprice / 1000), 6) AS elapsed, round(avg(o_custkey), 6) AS tokens, round(max(o_custkey * 100000) / 1073741824.0::DOUBLE, 9) AS peak_gb, round(avg(o_custkey) / avg(o_totalprice / 1000), 6) AS tps FROM orders GROUP BY 1""")
def generation_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("run"), (F.col("o_totalprice") / 1000).alias("seconds"), F.col("o_custkey").alias("tokens"), (F.col("o_custkey") * 100000).alias("peak"))
    return C.throughput(o, ["run"]).select("run", F.round("elapsed", 6).alias("elapsed"), F.round("tokens", 6).alias("tokens"), F.round("peak_gb", 9).alias("peak_gb"), F.round("tps", 6).alias("tps"))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, turn, len(regexp_extract_all(pt, '\\S+')) AS lw, len(regexp_extract_all(gt, '\\S+')) AS tw, (turn % 5) / 5.0::DOUBLE AS judge, (conv_id % 10) / 10.0::DOUBLE AS acc FROM pairs)
SELECT conv_id, turn, round(0.7::DOUBLE * judge + 0.3::DOUBLE * (0.6::DOUBLE * acc + 0.4::DOUBLE * (1 - lw / tw::DOUBLE)) / 2, 9) + 0.0::DOUBLE AS reward FROM s WHERE tw > 0""")
def structure_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's score and a memory's utility as one reward."""
    from .score_queries import _pairs

    words = _pairs(spark, sf_dir).select(*KEY, X.word_count(F.col("pt")).alias("lw"), X.word_count(F.col("gt")).alias("tw")).where("tw > 0")
    memory = C.memory_utility((F.col("conv_id") % 10) / F.lit(10.0), F.col("lw"), F.col("tw"))
    return words.select(*KEY, F.round(C.reward((F.col("turn") % 5) / F.lit(5.0), memory), 9).alias("reward"))


@query("""
SELECT source, count(*) AS samples, greatest(1, ceil(greatest(1, ceil(greatest(1, ceil(greatest(1, ceil(count(*) / 8.0)) / 4.0)) * 2.5)) * 0.03))::INT AS warmup, greatest(1, ceil(100 * 0.03))::INT AS fixed FROM documents GROUP BY 1""")
def warmup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("samples"))
    return d.select("source", "samples", C.warmup_steps(F.col("samples"), 4, 2, 4, 2.5, 0, 0.03).alias("warmup"), C.warmup_steps(F.col("samples"), 4, 2, 4, 2.5, 100, 0.03).alias("fixed"))


@query("""
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s) AS r, s FROM (SELECT conv_id, turn, text, 0 AS s FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, upper(role), 1 FROM conversations))
SELECT conv_id AS sample, turn AS question, md5(text) AS record_md5, row_number() OVER (ORDER BY conv_id, turn) AS place FROM a WHERE r = 1""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several shards as one list in (sample, question) order, the first shard's where both have one."""
    c = table(spark, sf_dir, "conversations")
    both = c.where("turn % 2 = 0").select("conv_id", "turn", "text", F.lit(0).alias("s")).unionByName(c.select("conv_id", "turn", F.upper("role").alias("text"), F.lit(1).alias("s")))
    one = both.groupBy(F.col("conv_id").alias("sample"), F.col("turn").alias("question")).agg(F.md5(F.min_by("text", "s")).alias("record_md5"))
    return R.numbered(one, ["sample", "question"], "place").withColumn("place", F.col("place") + 1)


@query("""
WITH m AS (SELECT conv_id, turn, turn // 2 AS message FROM conversations WHERE role <> 'system'), e AS (SELECT conv_id, count(*) AS units FROM conversations WHERE turn % 2 = 0 AND role <> 'system' GROUP BY 1)
SELECT m.conv_id, count(DISTINCT message) AS messages, coalesce(max(units), 0) AS units, count(DISTINCT message) = coalesce(max(units), 0) AS ok FROM m LEFT JOIN e USING (conv_id) GROUP BY 1""")
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether as many messages were written as there are units of evidence."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.groupBy("conv_id").agg(F.countDistinct(F.floor(F.col("turn") / 2)).alias("messages"), F.count_if(F.col("turn") % 2 == 0).alias("units")).withColumn("ok", F.col("messages") == F.col("units"))


@query("""
SELECT a.conv_id, a.turn, count(b.turn) AS messages, md5(coalesce(string_agg('[' || b.role || '] ' || b.text, chr(10) ORDER BY b.turn), '') || chr(10) || 'Question: ' || a.text || chr(10) || 'Short answer:') AS prompt_md5
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'user' GROUP BY a.conv_id, a.turn, a.text""")
def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question behind its conversation's whole history."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    asked = turns.select("conv_id", "t", F.explode(F.filter("t", lambda x: x["role"] == "user")).alias("a"))
    before = F.filter("t", lambda x: x["turn"] < F.col("a.turn"))
    lines = F.transform(before, lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"]))
    prompt = F.concat(F.array_join(lines, "\n"), F.lit("\n"), P.qa_prompt(F.col("a.text"), guided=False))
    return asked.select("conv_id", F.col("a.turn").alias("turn"), F.size(before).cast("long").alias("messages"), F.md5(prompt).alias("prompt_md5"))


@query("""
WITH l AS (SELECT l_orderkey AS row_id, list(l_linestatus ORDER BY l_linenumber, l_linestatus) AS qs, list(l_returnflag ORDER BY l_linenumber, l_returnflag)[:2] AS kinds FROM lineitem GROUP BY 1)
SELECT row_id, i::INT AS i, 'Task ' || coalesce(kinds[i + 1], '') || ': ' || qs[i + 1] || '?' AS query, md5('At 2024-01-01 this was read; keep it in mind:' || chr(10) || qs[i + 1]) AS chunk_md5 FROM (SELECT *, unnest(range(len(qs))) AS i FROM l)""")
def templated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of questions and metadata row by row in a template, and chunks wrapped for a memory."""
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("l_linenumber", c)))[c]
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(ordered("l_linestatus").alias("qs"), F.slice(ordered("l_returnflag"), 1, 2).alias("kinds"))  # noqa: E741
    rows = l.select("row_id", F.posexplode(F.arrays_zip(F.col("qs").alias("q"), F.col("kinds").alias("k"))).alias("i", "x"))
    return rows.select("row_id", "i", P.filled("Task {kind}: {question}?", kind=F.col("x.k"), question=F.col("x.q")).alias("query"), F.md5(P.memorised(F.col("x.q"), F.lit("2024-01-01"))).alias("chunk_md5"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(role || ': ' || text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(role || ': ' || text, '\\S+'), 1) - 1 AS i FROM conversations)
SELECT conv_id, turn, i, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1) AS token, CASE WHEN i = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS message FROM w""")
def write_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which message each token writes to; a turn's first token, its speaker, writes to none (-1)."""
    c = table(spark, sf_dir, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.concat("role", F.lit(": "), "text"), F.lit(r"\S+"), F.lit(0))).alias("i", "word"))
    of = Window.partitionBy("conv_id")
    token = F.row_number().over(of.orderBy("turn", "i")) - 1
    message = F.when(F.col("i") == 0, -1).otherwise(F.dense_rank().over(of.orderBy("turn")) - 1)
    return w.select("conv_id", "turn", F.col("i").cast("long").alias("i"), token.cast("long").alias("token"), message.cast("long").alias("message"))


@query("""
SELECT coalesce(lang, 'all') AS category, printf('%d/%d (%.1f%%)', sum(quality)::INT, count(*)::INT, 100.0 * sum(quality) / count(*)) AS line FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang)) HAVING grouping(lang) = 1 OR lang IS NOT NULL""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed table of a run: hits, number and percentage by category and in all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    sums = rows.rollup("lang").agg(F.sum("quality").alias("hit"), F.count("*").alias("n"), F.grouping("lang").alias("all"))
    return sums.where("all = 1 OR lang IS NOT NULL").select(F.when(F.col("all") == 1, "all").otherwise(F.col("lang")).alias("category"), C.ratio_text(F.col("hit"), F.col("n")).alias("line"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS domain, chr(65 + (l_partkey % 4)::INT) AS gold, CASE WHEN l_suppkey % 3 = 0 THEN 'no idea' ELSE 'Final answer: ' || chr(65 + (l_suppkey % 4)::INT) END AS said, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE chr(65 + (l_suppkey % 4)::INT) END AS letter FROM lineitem)
SELECT domain, count(*) AS n, round(avg(CASE WHEN letter = gold THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM p GROUP BY GROUPING SETS ((), (domain))""")
def choice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of chosen letters, in all and by domain."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    letter = lambda c: F.substring(F.lit("ABCD"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("l_suppkey") % 3 == 0, "no idea").otherwise(F.concat(F.lit("Final answer: "), letter("l_suppkey")))
    rows = l.select(F.col("l_returnflag").alias("domain"), letter("l_partkey").alias("gold"), said.alias("said"))
    hit = F.coalesce((X.choice_letter(F.col("said")) == F.col("gold")).cast("double"), F.lit(0.0))
    return rows.rollup("domain").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))
