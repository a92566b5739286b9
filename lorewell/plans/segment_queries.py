"""Segmentation of conversations, documents and event streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..operators import segments as S
from ..registry import query
from ..session import table


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
r AS (SELECT conv_id, turn, n AS fill, 0 AS batch FROM t WHERE turn = 0
  UNION ALL SELECT t.conv_id, t.turn, CASE WHEN fill > 0 AND fill + n > 300 THEN n ELSE fill + n END, CASE WHEN fill > 0 AND fill + n > 300 THEN batch + 1 ELSE batch END FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
SELECT conv_id, turn, batch FROM r""")
def char_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batched(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 300)


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) + 8 AS n FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN n >= 60 THEN 0 ELSE n END AS fill, 0 AS chunk, CASE WHEN n >= 60 THEN 1 ELSE 0 END AS nxt FROM t WHERE turn = 0
  UNION ALL SELECT t.conv_id, t.turn, CASE WHEN fill + n >= 60 THEN 0 ELSE fill + n END, nxt, CASE WHEN fill + n >= 60 THEN nxt + 1 ELSE nxt END FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
SELECT conv_id, turn, chunk FROM r""")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut behind the message that reaches the budget."""
    c = table(spark, sf_dir, "conversations")
    return S.batched(c, "conv_id", "turn", X.word_count(F.col("text")) + 8, 60, after=True).withColumnRenamed("batch", "chunk")


@query("""
WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM t)
SELECT conv_id, turn, total::BIGINT AS total FROM s WHERE total < 60""")
def context_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the last one back while they fit; sizes are positive, so the first overflow ends the run."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.word_count(F.col("text")).cast("long").alias("n"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("total < 60").select("conv_id", "turn", "total")


@query("""
SELECT doc_id, i::INT AS piece, array_to_string(w[i * 120 + 1 : i * 120 + 120], ' ') AS words FROM (
  SELECT doc_id, w, unnest(range(greatest(1, (len(w) + 119) // 120))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))""")
def long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(S.word_windows(F.col("text"), 120)).alias("piece", "words"))


@query("""
WITH RECURSIVE b AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S')) AS p, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
w AS (SELECT doc_id, generate_subscripts(x, 1) AS bi, regexp_extract_all(unnest(x), '\\S+') AS w FROM (SELECT doc_id, CASE WHEN len(p) < 2 THEN l ELSE p END AS x FROM b)),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bi, k) AS i, array_to_string(w[k * 300 + 1 : k * 300 + 300], ' ') AS t, least(300, len(w) - k * 300) AS n FROM (SELECT *, unnest(range((len(w) + 299) // 300)) AS k FROM w)),
r AS (SELECT doc_id, i, t, CASE WHEN n >= 180 THEN 301 ELSE n END AS fill, 0 AS passage_no FROM pieces WHERE i = 1
  UNION ALL SELECT doc_id, i, t, CASE WHEN f >= 180 THEN 301 ELSE f END, passage_no FROM (SELECT p.doc_id, p.i, p.t, CASE WHEN fill + n > 300 THEN n ELSE fill + n END AS f, CASE WHEN fill + n > 300 THEN passage_no + 1 ELSE passage_no END AS passage_no FROM r JOIN pieces p ON p.doc_id = r.doc_id AND p.i = r.i + 1))
SELECT doc_id, passage_no::INT AS passage_no, string_agg(t, chr(10) ORDER BY i) AS passage FROM r GROUP BY 1, 2""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(table(spark, sf_dir, "documents"), "doc_id")


UNIGRAM_SQL = """t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations),
u AS (SELECT token, -ln(count(*) / (SELECT count(*) FROM t)::DOUBLE) AS s FROM t GROUP BY token),
p AS (SELECT conv_id, turn, round(avg(s), 6) AS surprisal FROM t JOIN u USING (token) GROUP BY 1, 2)"""


def _surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean token surprisal of each turn under the corpus unigram model, which stands in for a language model."""
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    total = tokens.count()
    weights = tokens.groupBy("token").agg((-F.log(F.count("*") / F.lit(float(total)))).alias("s"))
    return tokens.join(weights, "token").groupBy("conv_id", "turn").agg(F.round(F.avg("s"), 6).alias("surprisal"))


@query(f"""WITH {UNIGRAM_SQL}, m AS (SELECT conv_id, avg(surprisal) + 0.5::DOUBLE * stddev_samp(surprisal) AS lim FROM p GROUP BY 1)
SELECT conv_id, turn, surprisal, coalesce(surprisal > lim, false) AS boundary, (sum(CASE WHEN surprisal > lim AND turn > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS episode FROM p JOIN m USING (conv_id)""")
def surprise_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = S.surprise_flags(_surprisal(spark, sf_dir), "conv_id", "turn", "surprisal", 0.5)
    return S.episodes(flags, "conv_id", "turn")


@query("""
SELECT event_id, user_id, coalesce(value > avg(value) OVER w + 1.0::DOUBLE * stddev_samp(value) OVER w, false) AS boundary FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def rolling_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries against the last eight values."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return S.surprise_flags(e, "user_id", "event_id", "value", 1.0, 8).select("event_id", "user_id", "boundary")


@query("""
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, min(pos) AS span_start, max(pos) + 1 AS span_end, count(*) AS n FROM o GROUP BY user_id, pos // 16""")
def uniform_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sixteen events, as gap-free spans."""
    o = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"))
    spans = o.groupBy("user_id", F.floor(F.col("pos") / 16).alias("b")).agg(F.min("pos").cast("long").alias("span_start"), (F.max("pos") + 1).cast("long").alias("span_end"), F.count("*").alias("n"))
    return spans.drop("b")


@query("""
WITH len AS (SELECT doc_id, length(text) AS n FROM documents), marks AS (
  SELECT doc_id, 0 AS m FROM len UNION SELECT doc_id, n FROM len UNION SELECT doc_id, unnest(range(500, n, 500)) FROM len)
SELECT doc_id, m::INT AS span_start, e::INT AS span_end FROM (SELECT doc_id, m, lead(m) OVER (PARTITION BY doc_id ORDER BY m) AS e FROM marks) WHERE e IS NOT NULL""")
def span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at every 500 characters, with both ends added and turned into spans."""
    n = F.length("text")
    cuts = F.when(n > 500, F.sequence(F.lit(500), n - 1, F.lit(500))).otherwise(F.array().cast("array<int>"))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), cuts)))
    d = table(spark, sf_dir, "documents").select("doc_id", marks.alias("m"))
    return d.select("doc_id", F.explode(F.arrays_zip(F.slice("m", F.lit(1), F.size("m") - 1).alias("a"), F.slice("m", F.lit(2), F.size("m") - 1).alias("b"))).alias("s")).select("doc_id", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))


@query("""
WITH o AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
cuts AS (SELECT DISTINCT conv_id, unnest(range(200, total::BIGINT, 200)) AS cut FROM o),
s AS (SELECT cuts.conv_id, cut, min_by(turn, abs(begins - cut) * 1000 + turn) AS turn FROM cuts JOIN o USING (conv_id) GROUP BY 1, 2),
f AS (SELECT o.conv_id, o.turn, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.conv_id = o.conv_id AND s.turn = o.turn AND o.turn > 0) THEN 1 ELSE 0 END AS st FROM o)
SELECT conv_id, turn, (sum(st) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS grp FROM f""")
def snap_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at every 200 characters, each moved to the nearest turn start (the first of equally near ones)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    o = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"), F.sum(F.length("text")).over(Window.partitionBy("conv_id")).alias("total"))
    cuts = o.groupBy("conv_id").agg(F.max("total").alias("t")).where("t > 200").select("conv_id", F.explode(F.sequence(F.lit(200), (F.col("t") - 1).cast("int"), F.lit(200))).alias("cut"))
    near = cuts.join(o, "conv_id").groupBy("conv_id", "cut").agg(F.min(F.struct(F.abs(F.col("at") - F.col("cut")).alias("d"), "turn")).alias("x"))
    starts = near.select("conv_id", F.col("x.turn").alias("turn"), F.lit(1).alias("st")).where("turn > 0").distinct()
    return o.join(starts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.sum(F.coalesce("st", F.lit(0))).over(w).alias("grp"))


@query("""
WITH e AS (SELECT vec_id, vec_id // 10 AS stream, vec_id % 10 AS pos, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT x.stream, x.pos AS i, y.pos AS j, list_cosine_similarity(x.v, y.v) + 1 AS w FROM e x JOIN e y ON x.stream = y.stream),
m AS (SELECT stream, sum(w) AS total FROM a GROUP BY 1), k AS (SELECT stream, i, sum(w) AS k FROM a GROUP BY 1, 2)
SELECT a.stream, round(sum(CASE WHEN (a.i < 5) = (a.j < 5) THEN w - ki.k * kj.k / total ELSE 0 END) / (2 * any_value(total)), 6) AS modularity
FROM a JOIN m USING (stream) JOIN k ki ON ki.stream = a.stream AND ki.i = a.i JOIN k kj ON kj.stream = a.stream AND kj.i = a.j GROUP BY a.stream""")
def modularity_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the split in the middle of every ten vectors, over their similarity edges."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("stream"), (F.col("vec_id") % 10).alias("pos"), V.doubles(F.col("embedding")).alias("v"))
    a = e.alias("x").join(e.alias("y"), F.col("x.stream") == F.col("y.stream")).select(F.col("x.stream").alias("stream"), F.col("x.pos").alias("i"), F.col("y.pos").alias("j"), (V.cosine(F.col("x.v"), F.col("y.v")) + 1).alias("w"))
    w = Window.partitionBy("stream")
    a = a.withColumn("total", F.sum("w").over(w)).withColumn("ki", F.sum("w").over(Window.partitionBy("stream", "i"))).withColumn("kj", F.sum("w").over(Window.partitionBy("stream", "j")))
    inside = (F.col("i") < 5) == (F.col("j") < 5)
    return a.groupBy("stream").agg(F.round(F.sum(F.when(inside, F.col("w") - F.col("ki") * F.col("kj") / F.col("total")).otherwise(0.0)) / (2 * F.first("total")), 6).alias("modularity"))


_BLOCK_SQL = "coalesce(list_sum(flatten(list_transform(range({a}, {b}), lambda i: list_transform(range({c}, {d}), lambda j: m[i + 1][j + 1])))), 0)"


@query(f"""
WITH RECURSIVE e AS (SELECT vec_id // 25 AS stream, vec_id % 25 AS pos, embedding::DOUBLE[] AS v FROM embeddings),
w AS (SELECT x.stream, x.pos, list(list_dot_product(x.v, y.v) + 1 ORDER BY y.pos) AS row FROM e x JOIN e y ON x.stream = y.stream GROUP BY 1, 2),
g AS (SELECT stream, list(row ORDER BY pos) AS m, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT stream, m, n, 0 AS k, 0::BIGINT AS cut FROM g
  UNION ALL SELECT stream, m, n, k + 1, CASE WHEN e - prev > 2 AND e > 2 THEN coalesce(list_sort(list_transform(range(prev + 2, e), lambda s: {{'x': -(({_BLOCK_SQL.format(a='lo', b='s', c='lo', d='s')} + {_BLOCK_SQL.format(a='s', b='hi', c='s', d='hi')}) - (pow({_BLOCK_SQL.format(a='lo', b='s', c='lo', d='hi')}, 2) + pow(total - {_BLOCK_SQL.format(a='lo', b='s', c='lo', d='hi')}, 2)) / total) / (2 * total), 's': s}}))[1].s, prev + 2) ELSE e END
  FROM (SELECT *, {_BLOCK_SQL.format(a='lo', b='hi', c='lo', d='hi')} AS total FROM (SELECT *, greatest(0, prev - (e - prev) // 2) AS lo, least(n, e + (e - prev) // 2) AS hi FROM (SELECT stream, m, n, k, cut AS prev, (k + 1) * 5 AS e FROM r WHERE (k + 1) * 5 < n))))
SELECT stream, (k - 1)::INT AS event, cut::INT AS at FROM r WHERE k > 0""")
def refined_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries at every fifth vector of streams of twenty-five, moved to the best modularity split."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("stream"), "vec_id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        events = list(range(5, len(m), 5))
        got = S.refine(events, m @ m.T + 1.0, "modularity", 2) if events else []
        return pd.DataFrame({"stream": pdf["stream"].iloc[0], "event": range(len(got)), "at": got})

    return e.groupBy("stream").applyInPandas(run, "stream long, event int, at int")


@query("""
SELECT conv_id, turn, greatest(1, len(regexp_extract_all(text, '\\S+')))::INT AS n, (sum(greatest(1, len(regexp_extract_all(text, '\\S+')))) OVER (PARTITION BY conv_id ORDER BY turn) - greatest(1, len(regexp_extract_all(text, '\\S+'))))::BIGINT AS begins FROM conversations""")
def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token offset of every turn, one token at least."""
    n = F.greatest(F.lit(1), X.word_count(F.col("text")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"))
    return c.withColumn("begins", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("n"))
