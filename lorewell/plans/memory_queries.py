"""Memory tiers over events and embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as M
from ..functions import vectors as V
from ..operators import memory as Y
from ..registry import query
from ..session import table

NOW = "2024-02-01 00:00:00"


@query(f"""
SELECT user_id, round(0.4::DOUBLE * least(1.0::DOUBLE, ln(1 + n) / 10.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, 0.1::DOUBLE * n) + 0.3::DOUBLE * exp(-age / 86400.0::DOUBLE), 9) AS utility,
  n >= 1 AND exp(-age / 604800.0::DOUBLE) >= 0.01 AS eligible FROM (SELECT user_id, count(*) AS n, epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts))) AS age FROM events GROUP BY 1)""")
def session_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))).cast("double").alias("age"))
    return s.select("user_id", F.round(M.utility(F.col("n"), F.lit(0.1) * F.col("n"), F.col("age")), 9).alias("utility"), M.eligible(F.col("n"), F.col("age"), F.lit(1.0)).alias("eligible"))


@query("SELECT user_id, event_id, lag(event_id, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS evicted FROM events")
def lru_buffer_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.buffer_evictions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", 4)


@query("""
SELECT user_id, event_id, n % 10 = 0 AS consolidate, ['linear', 'hypergraph', 'hierarchical'][(n - 1) % 3 + 1] AS structure FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def periodic_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth turn consolidates; structures are given out round robin."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n"))
    kinds = F.array(F.lit("linear"), F.lit("hypergraph"), F.lit("hierarchical"))
    return e.select("user_id", "event_id", (F.col("n") % 10 == 0).alias("consolidate"), F.get(kinds, ((F.col("n") - 1) % 3).cast("int")).alias("structure"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type || (floor(value)::BIGINT % 3) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, [k] AS c, false AS hit, NULL::VARCHAR AS evicted FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, CASE WHEN hit THEN c WHEN len(c) >= 4 THEN list_append(c[2:], k) ELSE list_append(c, k) END, hit, CASE WHEN NOT hit AND len(c) >= 4 THEN c[1] END
  FROM (SELECT e.*, r.c, list_contains(r.c, e.k) AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, hit, evicted FROM r""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and evictions of a cache of four that drops the first inserted."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat("event_type", F.floor("value") % 3).alias("k"))
    return Y.cache_events(e, "user_id", ["ts", "event_id"], "event_id", "k", 4)


def _grouped(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / size).alias("grp"), "vec_id", "embedding")


def _shape_sql(mean: str, variance: str) -> tuple[str, str]:
    spread = f"greatest(({mean}) * (1 - ({mean})) / greatest({variance}, 1e-8) - 1, 0.1::DOUBLE)"
    return f"greatest(({mean}) * {spread}, 0.1::DOUBLE)", f"greatest((1 - ({mean})) * {spread}, 0.1::DOUBLE)"


_BETA_SQL = "ln(greatest(s{k}, 1e-300)) + lgamma(a{k} + b{k}) - lgamma(a{k}) - lgamma(b{k}) + (a{k} - 1) * ln(x) + (b{k} - 1) * ln(1 - x)"
_OWN_SQL = "list_transform(xs, lambda x: 1 / (1 + exp(({}) - ({}))))".format(_BETA_SQL.format(k=1), _BETA_SQL.format(k=0))


@query(f"""
WITH RECURSIVE e AS (SELECT vec_id, vec_id // 20 AS grp, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT grp, arg_min(v, vec_id) AS h, min(vec_id) AS first FROM e GROUP BY 1),
s AS (SELECT e.grp, e.vec_id, list_dot_product(e.v, f.h) AS d FROM e JOIN f USING (grp) WHERE e.vec_id <> f.first), b AS (SELECT grp, min(d) AS lo, max(d) AS hi FROM s GROUP BY 1),
x AS (SELECT s.grp, s.vec_id, s.d, CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(greatest(1e-6 + (1 - 2e-6) * (d - lo) / (hi - lo), 1e-6), 1 - 1e-6) END AS x FROM s JOIN b USING (grp)),
g AS (SELECT grp, list(x ORDER BY vec_id) AS xs, count(*)::DOUBLE AS n, quantile_cont(x, 0.3) AS q0, quantile_cont(x, 0.7) AS q1 FROM x GROUP BY 1),
r AS (SELECT grp, 0 AS t, 0.5::DOUBLE AS s0, 0.5::DOUBLE AS s1, {_shape_sql("q0", "0.05::DOUBLE")[0]} AS a0, {_shape_sql("q0", "0.05::DOUBLE")[1]} AS b0, {_shape_sql("q1", "0.05::DOUBLE")[0]} AS a1, {_shape_sql("q1", "0.05::DOUBLE")[1]} AS b1 FROM g
  UNION ALL SELECT grp, t + 1, w0 / n, w1 / n, CASE WHEN w0 >= 1e-9 THEN {_shape_sql("m0", "v0")[0]} ELSE a0 END, CASE WHEN w0 >= 1e-9 THEN {_shape_sql("m0", "v0")[1]} ELSE b0 END, CASE WHEN w1 >= 1e-9 THEN {_shape_sql("m1", "v1")[0]} ELSE a1 END, CASE WHEN w1 >= 1e-9 THEN {_shape_sql("m1", "v1")[1]} ELSE b1 END
  FROM (SELECT *, list_sum(list_transform(xs, lambda x, i: o[i] * (x - m0) * (x - m0))) / w0 AS v0, list_sum(list_transform(xs, lambda x, i: (1 - o[i]) * (x - m1) * (x - m1))) / w1 AS v1
    FROM (SELECT *, list_sum(list_transform(xs, lambda x, i: o[i] * x)) / w0 AS m0, list_sum(list_transform(xs, lambda x, i: (1 - o[i]) * x)) / w1 AS m1
      FROM (SELECT *, list_sum(o) AS w0, n - list_sum(o) AS w1 FROM (SELECT r.*, g.xs, g.n, {_OWN_SQL} AS o FROM r JOIN g USING (grp) WHERE t < 20))))),
z AS (SELECT r.grp, {_OWN_SQL} AS o, a1 / (a1 + b1) > a0 / (a0 + b0) AS upper, n FROM r JOIN g USING (grp) WHERE t = 20),
k AS (SELECT x.grp, x.vec_id, x.d, CASE WHEN n < 2 THEN 1 WHEN upper THEN 1 - o[row_number() OVER (PARTITION BY x.grp ORDER BY x.vec_id)] ELSE o[row_number() OVER (PARTITION BY x.grp ORDER BY x.vec_id)] END AS gate, n FROM x JOIN z USING (grp)),
p AS (SELECT *, max(gate >= 0.6) OVER (PARTITION BY grp) AS any_passed, row_number() OVER (PARTITION BY grp ORDER BY d DESC, vec_id DESC) AS best FROM k)
SELECT grp, vec_id, round(gate, 6)::DOUBLE AS gate, CASE WHEN n < 2 THEN true WHEN any_passed THEN gate >= 0.6 ELSE best = 1 END AS accepted FROM p""")
def beta_mixture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate posteriors of cosine scores within groups of twenty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = np.array(pdf["embedding"].tolist(), float)
        scores = m @ m[0]
        accepted = set(Y.gate_accepts(scores[1:])) if len(scores) > 1 else set()
        return pd.DataFrame({"grp": pdf["grp"].iloc[1:], "vec_id": pdf["vec_id"].iloc[1:], "gate": np.round(Y.mixture_gate(scores[1:]), 6), "accepted": [i in accepted for i in range(len(scores) - 1)]})

    return _grouped(spark, sf_dir, 20).groupBy("grp").applyInPandas(run, "grp long, vec_id long, gate double, accepted boolean")


def _clusters_sql(size: int, least: float, by: str, label: str) -> str:
    """Greedy clustering as a recursion over the vectors of a group, its state the centres and their sizes."""
    return f"""
WITH RECURSIVE p AS (SELECT vec_id // {size} AS grp, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id // {size} ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT grp, vec_id, i, [v] AS c, [1] AS n, 1 AS home FROM p WHERE i = 1
  UNION ALL SELECT grp, vec_id, i, CASE WHEN home > len(c) THEN list_append(c, v) ELSE list_transform(range(1, len(c) + 1), lambda k: CASE WHEN k = home THEN list_transform(range(1, len(v) + 1), lambda d: c[k][d] + (v[d] - c[k][d]) / (n[k] + 1)) ELSE c[k] END) END,
    CASE WHEN home > len(c) THEN list_append(n, 1) ELSE list_transform(range(1, len(n) + 1), lambda k: CASE WHEN k = home THEN n[k] + 1 ELSE n[k] END) END, home
  FROM (SELECT p.grp, p.vec_id, p.i, p.v, r.c, r.n, coalesce(list_filter(range(1, len(r.c) + 1), lambda k: list_cosine_similarity(r.c[k], p.v) >= {least})[1], len(r.c) + 1)::INT AS home FROM r JOIN p ON p.grp = r.grp AND p.i = r.i + 1))
SELECT grp AS {by}, vec_id, home - 1 AS {label} FROM r"""


@query(_clusters_sql(50, 0.2, "grp", "cluster"))
def greedy_cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"grp": pdf["grp"], "vec_id": pdf["vec_id"], "cluster": Y.greedy_clusters(np.array(pdf["embedding"].tolist(), float), 0.2)})

    return _grouped(spark, sf_dir, 50).groupBy("grp").applyInPandas(run, "grp long, vec_id long, cluster int")


@query("""
WITH RECURSIVE g AS (SELECT vec_id // 20 AS grp, list(embedding::DOUBLE[] ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids, count(*) AS n FROM embeddings GROUP BY 1),
r AS (SELECT grp, n, list_transform(vs, lambda v, i: {'f': i, 'm': 1::DOUBLE, 'v': v}) AS c, list_transform(vs, lambda v, i: i) AS own, greatest(2, round_even(n / 5.0::DOUBLE, 0)) AS most, false AS done FROM g
  UNION ALL SELECT grp, n, list_transform(list_filter(c, lambda e, k: k <> best.j), lambda e: CASE WHEN e.f = c[best.i].f THEN {'f': e.f, 'm': e.m + c[best.j].m, 'v': list_transform(e.v, lambda x, d: (x * e.m + c[best.j].v[d] * c[best.j].m) / (e.m + c[best.j].m))} ELSE e END),
    list_transform(own, lambda o: CASE WHEN o = c[best.j].f THEN c[best.i].f ELSE o END), most, len(c) - 1 <= most
  FROM (SELECT *, list_sort(flatten(list_transform(range(1, len(c)), lambda i: list_transform(range(i + 1, len(c) + 1), lambda j: {'cost': round(c[i].m * c[j].m / (c[i].m + c[j].m) * list_sum(list_transform(range(1, len(c[i].v) + 1), lambda d: pow(c[i].v[d] - c[j].v[d], 2))), 12), 'i': i, 'j': j}))))[1] AS best FROM r WHERE len(c) > most)),
f AS (SELECT grp, own FROM r WHERE len(c) <= most QUALIFY row_number() OVER (PARTITION BY grp ORDER BY len(c) DESC) = 1),
u AS (SELECT g.grp, unnest(g.ids) AS vec_id, unnest(f.own) AS o FROM g JOIN f USING (grp))
SELECT grp, vec_id, (dense_rank() OVER (PARTITION BY grp ORDER BY o) - 1)::INT AS topic FROM u""")
def ward_retopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a conversation in balanced topics: max(2, round(n / 5)) Ward clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        labels = Y.ward(np.array(pdf["embedding"].tolist(), float), max(2, round(len(pdf) / 5)))
        return pd.DataFrame({"grp": pdf["grp"], "vec_id": pdf["vec_id"], "topic": labels})

    return _grouped(spark, sf_dir, 20).groupBy("grp").applyInPandas(run, "grp long, vec_id long, topic int")


@query("SELECT vec_id // 25 AS grp, vec_id, 0 AS session FROM embeddings")
def gated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of pages by the gate, which keeps one at least: all pages of a group join the first page's."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"grp": pdf["grp"], "vec_id": pdf["vec_id"], "session": Y.gated_sessions(np.array(pdf["embedding"].tolist(), float))})

    return _grouped(spark, sf_dir, 25).groupBy("grp").applyInPandas(run, "grp long, vec_id long, session int")


@query("""
WITH RECURSIVE p AS (SELECT vec_id // 25 AS grp, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) - 1 AS i FROM embeddings),
r AS (SELECT grp, -1::BIGINT AS i, []::STRUCT(id BIGINT, v DOUBLE[], used INT, seen DOUBLE)[] AS s FROM (SELECT DISTINCT grp FROM p)
  UNION ALL SELECT grp, i, CASE WHEN len(n) > 8 THEN list_filter(n, lambda e, k: k <> list_filter(range(1, len(n) + 1), lambda j: NOT (n[j].used >= 1 AND exp(-(now - n[j].seen) / 604800) >= 0.01))[1]) ELSE n END
  FROM (SELECT *, CASE WHEN twin IS NOT NULL THEN list_transform(s, lambda e, k: CASE WHEN k = twin THEN {'id': e.id, 'v': e.v, 'used': e.used + 1, 'seen': now} ELSE e END) ELSE list_append(s, {'id': vec_id, 'v': v, 'used': 0, 'seen': now}) END AS n
    FROM (SELECT p.grp, p.i, p.vec_id, p.v, (p.i * 3600)::DOUBLE AS now, r.s, list_filter(range(1, len(r.s) + 1), lambda k: list_cosine_similarity(r.s[k].v, p.v) > 0.3)[1] AS twin FROM r JOIN p ON p.grp = r.grp AND p.i = r.i + 1))),
l AS (SELECT grp, unnest(arg_max(s, i)) AS e FROM r GROUP BY grp)
SELECT grp, e.id AS vec_id, e.used AS used FROM l""")
def long_term_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids, used = Y.consolidate([(3600.0 * i, np.array(v, float), n) for i, (v, n) in enumerate(zip(pdf["embedding"], pdf["vec_id"], strict=True))], 8, 0.3)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "vec_id": ids, "used": used})

    return _grouped(spark, sf_dir, 25).groupBy("grp").applyInPandas(run, "grp long, vec_id long, used int")


_ROW_SQL = "s[4 * {a} + 1] * {x}[1] + s[4 * {a} + 2] * {x}[2] + s[4 * {a} + 3] * {x}[3] + s[4 * {a} + 4] * {x}[4]"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, [sin(value), sin(value * 2), sin(value * 3), sin(value * 4)] AS q, [sin(value * 2), sin(value * 3), sin(value * 4), sin(value * 5)] AS k, [sin(value * 3), sin(value * 4), sin(value * 5), sin(value * 6)] AS v, event_id % 5 > 0 AS valid FROM events),
r AS (SELECT user_id, 0::BIGINT AS step, list_transform(range(16), lambda i: 0::DOUBLE) AS s, 0::DOUBLE AS norm FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.step, CASE WHEN valid THEN list_transform(range(16), lambda i: 0.9::DOUBLE * s[i + 1] - 0.1::DOUBLE * ({_ROW_SQL.format(a='(i // 4)', x='k')}) * k[i % 4 + 1] + 0.5::DOUBLE * v[i // 4 + 1] * k[i % 4 + 1]) ELSE s END,
    CASE WHEN valid THEN sqrt(list_sum(list_transform(range(4), lambda a: pow({_ROW_SQL.format(a='a', x='q')}, 2)))) ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.step = r.step + 1),
l AS (SELECT user_id, sqrt(list_sum(list_transform(arg_max(s, step), lambda x: x * x))) AS state_norm FROM r GROUP BY 1)
SELECT r.user_id, r.step, round(norm, 6) AS read_norm, round(state_norm, 6) AS state_norm FROM r JOIN l USING (user_id) WHERE r.step > 0""")
def delta_rule_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as steps of an associative memory of width four."""
    e = table(spark, sf_dir, "events")
    wave = lambda p: F.array(*[F.sin(F.col("value") * F.lit(p + i)) for i in range(4)])
    steps = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"), wave(1).alias("q"), wave(2).alias("k"), wave(3).alias("v"), F.lit(0.9).alias("keep"), F.lit(0.1).alias("erase"), F.lit(0.5).alias("write"), (F.col("event_id") % 5 > 0).alias("valid"))
    return Y.delta_streams(steps, "user_id", "step").withColumns({c: F.round(c, 6) for c in ("read_norm", "state_norm")})


@query("""
WITH s AS (SELECT user_id, event_id, round(value / 100.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END, 9) AS s, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS r FROM s)
SELECT user_id, round(sum(exp(s) * value) / sum(exp(s)), 6) AS read, count(*) AS parts FROM r WHERE r <= 4 GROUP BY 1""")
def partition_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.round(F.col("value") / F.lit(100.0) + F.when(F.col("event_id") % 2 == 0, 0.25).otherwise(0.0), 9).alias("score"), F.lit(False).alias("is_global"))
    return Y.read_partitions(e, ["user_id"], "event_id", "score", "value", 4).withColumn("read", F.round("read", 6))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS question, b.vec_id AS entry, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, entry) AS r FROM s) WHERE r <= 5)
SELECT entry, count(*) AS used, round(max(sim), 9) AS best FROM t GROUP BY 1""")
def long_term_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest entries of each question, and how often each entry was used."""
    from ..operators.ranking import nearest

    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("v").alias("q_vec"))
    found = nearest(q, e.select(F.col("vec_id").alias("item"), F.col("v").alias("vec")), 5).withColumnRenamed("item", "entry")
    return found.groupBy("entry").agg(F.count("*").alias("used"), F.round(F.max("sim"), 9).alias("best"))


@query("""
WITH f AS (SELECT user_id, event_id, event_type = 'refund' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'refund' ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, g, count(*) AS run FROM f WHERE bad GROUP BY 1, 2)
SELECT e.user_id, coalesce(max(run), 0) AS longest_failure, coalesce(max(run), 0) >= 3 AS abort FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN r USING (user_id) GROUP BY 1""")
def health_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of failures of each worker; three end it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "refund")
    runs = e.withColumn("g", F.row_number().over(w) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))).groupBy("user_id", "g", "bad").agg(F.count("*").alias("run"))
    worst = F.max(F.when(F.col("bad"), F.col("run")).otherwise(0))
    return runs.groupBy("user_id").agg(worst.alias("longest_failure"), (worst >= 3).alias("abort"))
