"""Scores and their aggregates. Predictions are conversation turns scored against the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as M
from ..functions import text as X
from ..functions import vectors as V
from ..operators import ranking as R
from ..registry import query
from ..session import table

#: What tells the scored pairs apart.
KEY = ["conv_id", "turn"]
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
PAIRS_SQL = f"""pairs AS (SELECT a.conv_id, a.turn, {_TOK.format('a.text')} AS p, {_TOK.format('b.text')} AS g, a.text AS pt, b.text AS gt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)"""
SHARED_SQL = "coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gt"))
    tokens = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "), r"\s+"), lambda x: x != "")
    return c.select("conv_id", "turn", F.col("text").alias("pt")).join(before, ["conv_id", "turn"]).select("conv_id", "turn", "pt", "gt", tokens(F.col("pt")).alias("p"), tokens(F.col("gt")).alias("g"))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, turn, len(p) AS np, len(g) AS ng, {SHARED_SQL.format(p='p', g='g')}::DOUBLE AS s FROM pairs)
SELECT conv_id, turn, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 THEN 0 ELSE s / np END, 9) AS precision, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 THEN 0 ELSE s / ng END, 9) AS recall,
  round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 OR s = 0 THEN 0 ELSE 2 * (s / np) * (s / ng) / (s / np + s / ng) END, 9) AS f1 FROM s""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scored(_pairs(spark, sf_dir), KEY).select(*KEY, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _lists_sql(col: str) -> str:
    return f"list_filter(list_transform(str_split({col}, ','), lambda x: list_filter(regexp_split_to_array(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')), lambda l: len(l) > 0)"


@query(f"""WITH {PAIRS_SQL}, l AS (SELECT conv_id, turn, {_lists_sql('pt')} AS ps, {_lists_sql('gt')} AS gs FROM pairs),
g AS (SELECT conv_id, turn, ps, unnest(gs) AS g, generate_subscripts(gs, 1) AS gi FROM l), pg AS (SELECT conv_id, turn, gi, g, unnest(ps) AS p FROM g),
f AS (SELECT conv_id, turn, gi, max(CASE WHEN s = 0 THEN 0 ELSE 2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)) END) AS best FROM (SELECT *, {SHARED_SQL.format(p='p', g='g')}::DOUBLE AS s FROM pg) GROUP BY 1, 2, 3)
SELECT l.conv_id, l.turn, round(coalesce(avg(best), 0), 9) AS score FROM l LEFT JOIN f USING (conv_id, turn) GROUP BY 1, 2""")
def multi_answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda t: F.filter(F.transform(F.split(t, ","), lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"\s+"), lambda y: y != "")), lambda x: F.size(x) > 0)
    lists = _pairs(spark, sf_dir).select(*KEY, items(F.col("pt")).alias("ps"), items(F.col("gt")).alias("gs"))
    return M.listed_f1(lists, KEY).withColumn("score", F.round("score", 9))


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT conv_id, turn, p, unnest([g, p[:3], g[:5]]) AS g FROM pairs), s AS (SELECT *, {SHARED_SQL.format(p='p', g='g')}::DOUBLE AS s FROM a)
SELECT conv_id, turn, round(max(CASE WHEN s = 0 THEN 0 ELSE 2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)) END), 9) AS score FROM s GROUP BY 1, 2""")
def qa_f1_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best F1 over several accepted answers."""
    golds = F.array(F.col("g"), F.slice("p", 1, 3), F.slice("g", 1, 5))
    return M.best_f1(_pairs(spark, sf_dir).select(*KEY, "p", golds.alias("golds")), KEY).withColumn("score", F.round("score", 9))


@query()
def stemmed_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over Porter stems of dialogue answers."""
    stems = lambda t: X.stemmed(F.filter(F.split(X.answer_dialogue(X.decomposed(F.col(t))), " "), lambda x: x != ""))
    s = _pairs(spark, sf_dir).select("conv_id", "turn", stems("pt").alias("p"), stems("gt").alias("g"))
    return M.scored(s, KEY, both_empty=0.0).select(*KEY, F.round("f1", 9).alias("score"))


#: DuckDB compares bytes: there, each letter beyond ASCII that the table has becomes a control character of its own.
_BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES_SQL = f"translate({{}}, '{_BEYOND}', '{''.join(chr(i) for i in range(1, 32) if i not in (9, 10, 11, 12, 13))[: len(_BEYOND)]}')"


@query(f"""WITH {PAIRS_SQL} SELECT conv_id, turn, levenshtein({_BYTES_SQL.format('pt')}, {_BYTES_SQL.format('gt')})::INT AS distance FROM pairs""")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.levenshtein("pt", "gt").alias("distance"))


_INF = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda w: length(w) > 5 OR regexp_matches(w, '[0-9]') OR regexp_matches(w, '^[A-Z]{{3,}}$')), lambda w: lower(w)))"


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, turn, {_INF.format('gt')} AS g, {_INF.format('pt')} AS m FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_filter(g, lambda w: list_contains(m, w)))::DOUBLE / len(g) END, 9) AS accuracy FROM s""")
def informative_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.informative_accuracy(F.col("gt"), F.col("pt")), 9).alias("accuracy"))


@query("""
SELECT d.lang, d.source, round(avg(l.quality), 4) AS score, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((), (d.lang), (d.source))""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by category and by source in one pass."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return M.rolled_up(rows, ["lang", "source"], "quality").select("lang", "source", "score", "n")


@query("""
WITH r AS (SELECT source, lang, avg(quality) AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, round(sum(s * n) / sum(n), 4) AS score, sum(n)::BIGINT AS n, count(*) AS n_sources FROM r GROUP BY ROLLUP (lang)""")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample-weighted means: datasets to categories to overall."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    each = rows.groupBy("source", "lang").agg(F.avg("quality").alias("s"), F.count("*").alias("n"))
    return each.rollup("lang").agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 4).alias("score"), F.sum("n").alias("n"), F.count("*").alias("n_sources"))


@query("""
SELECT lang, count(*) AS n, round(avg(quality), 4) AS overall, round(avg(quality) FILTER (toxic = 0), 4) AS answered, count(*) FILTER (toxic = 1) AS skipped,
  round(100.0::DOUBLE * avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END), 4) AS judged_pct FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def summary_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all rows, over answered rows only, and a judged share with its own denominator."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(q), 4).alias("overall"), F.round(F.avg(F.when(t == 0, q)), 4).alias("answered"), F.count_if(t == 1).alias("skipped"), F.round(F.lit(100.0) * F.avg(((q == 1) & (t == 0)).cast("int")), 4).alias("judged_pct"))


@query("""
WITH i AS (SELECT l_orderkey AS prompt, list(l_returnflag ORDER BY l_linenumber) AS ids, list(l_quantity > 10 ORDER BY l_linenumber) AS strict, list(l_quantity > 5 ORDER BY l_linenumber) AS loose FROM lineitem GROUP BY 1),
x AS (SELECT prompt, unnest(ids) AS id, unnest(strict) AS s, unnest(loose) AS l FROM i)
SELECT id, count(*) AS n, round(avg(s::INT), 4) AS strict_rate, round(avg(l::INT), 4) AS loose_rate FROM x GROUP BY 1""")
def instruction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by instruction out of parallel arrays per prompt."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("prompt")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("id"), (F.col("l_quantity") > 10).alias("s"), (F.col("l_quantity") > 5).alias("l")))).alias("a"))
    x = rows.select(F.explode(F.arrays_zip(F.col("a.id").alias("id"), F.col("a.s").alias("s"), F.col("a.l").alias("l"))).alias("x")).select("x.*")
    return x.groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s").cast("int")), 4).alias("strict_rate"), F.round(F.avg(F.col("l").cast("int")), 4).alias("loose_rate"))


@query("""
WITH m AS (SELECT event_type, value AS f1, value * 2 AS prompt_len, value / 3 AS wall_time FROM events)
SELECT event_type, metric, round(avg(CASE WHEN metric IN ('prompt_len', 'wall_time') THEN v ELSE v * 100 END), 6) AS mean FROM (UNPIVOT m ON f1, prompt_len, wall_time INTO NAME metric VALUE v) GROUP BY 1, 2""")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each metric, times 100 except for lengths and times."""
    m = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("f1"), (F.col("value") * 2).alias("prompt_len"), (F.col("value") / 3).alias("wall_time"))
    long = m.unpivot("event_type", ["f1", "prompt_len", "wall_time"], "metric", "v").where("v IS NOT NULL")
    plain = F.col("metric").endswith("_len") | F.col("metric").endswith("_time")
    return long.groupBy("event_type", "metric").agg(F.round(F.avg(F.when(plain, F.col("v")).otherwise(F.col("v") * 100)), 6).alias("mean"))


BOOT = 200


@query(f"""
WITH d AS (SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value ELSE -value END), 6) AS diff FROM events GROUP BY 1), o AS (SELECT diff, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM d),
p AS (SELECT b, i AS slot, (('0x' || left(md5('7|' || b || '|' || i), 8))::BIGINT % n) AS pick FROM o CROSS JOIN (SELECT unnest(range({BOOT})) AS b)),
r AS (SELECT b, avg(diff) AS m FROM p JOIN o ON o.i = p.pick GROUP BY b), s AS (SELECT list_sort(list(m)) AS ms FROM r)
SELECT round((SELECT avg(diff) FROM d), 6) AS mean, round(ms[{int(0.025 * BOOT) + 1}], 6) AS low, round(ms[{int(0.975 * BOOT) + 1}], 6) AS high FROM s""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean difference; resampling by hash, so that every run and engine agrees."""
    signed = F.when(F.col("event_type") == "click", F.col("value")).otherwise(-F.col("value"))
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(signed), 6).alias("diff"))
    o = R.numbered(d, ["user_id"], "i").select("diff", "i")
    n = d.count()
    slots = spark.range(BOOT * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), "b", F.lit("|"), "slot")), 1, 8), 16, 10).cast("long") % n
    means = slots.select("b", pick.alias("i")).join(o, "i").groupBy("b").agg(F.avg("diff").alias("m")).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    at = lambda q: F.round(F.get("ms", F.lit(int(q * BOOT))), 6)
    return means.crossJoin(d.agg(F.round(F.avg("diff"), 6).alias("mean"))).select("mean", at(0.025).alias("low"), at(0.975).alias("high"))


@query("""
WITH a AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS x, round(avg(value) FILTER (event_type = 'view'), 6) AS y FROM events GROUP BY 1)
SELECT count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, count(*) FILTER (y > x + 1e-9) AS wins, count(*) FILTER (x > y + 1e-9) AS losses, count(*) FILTER (abs(x - y) <= 1e-9) AS ties FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import paired_arms

    d = F.col("b") - F.col("a")
    return paired_arms(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.count_if(d > 1e-9).alias("wins"), F.count_if(-d > 1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"))


@query("""
WITH h AS (SELECT l_orderkey AS question, l_partkey % 7 AS category, l_linestatus = 'F' AS hit FROM lineitem), q AS (SELECT question, min(category) AS category, avg(hit::INT) AS coverage, count(*) AS evidence FROM h GROUP BY 1)
SELECT category, count(*) AS n, round(avg((coverage = 1)::INT), 6) AS all_hit, round(avg(coverage), 6) AS mean_coverage, round(avg(evidence), 6) AS mean_evidence FROM q GROUP BY ROLLUP (category)""")
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.min(F.col("l_partkey") % 7).alias("category"), F.avg((F.col("l_linestatus") == "F").cast("int")).alias("coverage"), F.count("*").alias("evidence"))
    return q.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg((F.col("coverage") == 1).cast("int")), 6).alias("all_hit"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.avg("evidence"), 6).alias("mean_evidence"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'refund') AS refund FROM events GROUP BY 1""")
def kind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fixed kinds, 0 where a kind does not occur."""
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "refund"]).count().na.fill(0)


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*) AS turns, round(avg(n), 6) AS mean_length, count(DISTINCT role) AS speakers,
  round(CASE WHEN count(*) > 1 THEN count(*) FILTER (prev <> role)::DOUBLE / (count(*) - 1) ELSE 0 END, 6) AS transition_rate,
  round(sum(len(regexp_extract_all(text, '[0-9]+')))::DOUBLE / count(*), 6) AS number_density, round(sum(len(regexp_extract_all(text, '\\b[A-Z][a-z]{2,}')))::DOUBLE / count(*), 6) AS entity_density,
  round(least(1.0::DOUBLE, sum(n) / 3600.0::DOUBLE), 6) AS span FROM t GROUP BY 1""")
def conversation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("n", F.length("text")).withColumn("changed", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(False)))
    found = lambda p: F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))) / F.count("*")
    return t.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.round(F.avg("n"), 6).alias("mean_length"), F.countDistinct("role").alias("speakers"),
        F.round(F.when(F.count("*") > 1, F.count_if("changed") / (F.count("*") - 1)).otherwise(0.0), 6).alias("transition_rate"),
        F.round(found("[0-9]+"), 6).alias("number_density"), F.round(found(r"\b[A-Z][a-z]{2,}"), 6).alias("entity_density"), F.round(F.least(F.lit(1.0), F.sum("n") / F.lit(3600.0)), 6).alias("span"),
    )


@query("""
SELECT doc_id, round((n_chars - m) / (s + 1e-8), 6) AS z FROM documents CROSS JOIN (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)""")
def standardised_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x - mean) / (sample deviation + 1e-8); one aggregate row joins all others."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.crossJoin(d.agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("s"))).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / (F.col("s") + F.lit(1e-8)), 6).alias("z"))


@query("""
SELECT label, count(*) AS vectors, round(avg(sqrt(n)), 6) AS mean_norm, round(max(sqrt(n)), 6) AS max_norm, round(max(a), 6) AS max_abs FROM (
  SELECT label, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS n, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS a FROM embeddings) GROUP BY 1""")
def state_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", V.norm(V.doubles(F.col("embedding"))).alias("n"), F.array_max(F.transform(V.doubles(F.col("embedding")), lambda x: F.abs(x))).alias("a"))
    return e.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.max("a"), 6).alias("max_abs"))


@query("""
WITH c AS (SELECT vec_id // 8 AS message, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT message, dim::INT AS dim, round(avg(x), 9) AS x FROM c GROUP BY 1, 2""")
def message_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("message"), F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    return e.groupBy("message", "dim").agg(F.round(F.avg("x"), 9).alias("x"))


@query("""
WITH p AS (SELECT user_id, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2)
SELECT user_id, round(-sum(p * ln(p)), 9) AS entropy, round(max(p), 9) AS top_share FROM p GROUP BY 1""")
def route_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log("p")), 9).alias("entropy"), F.round(F.max("p"), 9).alias("top_share"))
