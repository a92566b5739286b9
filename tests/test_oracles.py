"""Every query against its SQL on the smallest tables."""

import math
import os
import random

import duckdb
import pytest

import __spark_entry__
from lorewell import plans, registry

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == columns
    want = sorted(repr([plain(r[at[c]]) for c in columns]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def equals_sql_on(spark, path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(path))
    rel = con.sql(__spark_entry__.oracle_sql()[name]).select(*df.columns)
    want = sorted(repr([plain(v) for v in r]) for r in rel.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


def test_aliases_of_other_letters(spark, tmp_path):
    """Letters whose other case is several letters, final sigma, marks, fractions, odd white space, no text."""
    words = ["Erßie", "STRAẞE", "ŉa", "ﬁn", "ΐ", "ᾳ", "İstanbul", "ΣΑΣ", "ǅ", "ɤ", "\U00010d70", "e\u0301t", "\u0301", "x²½", "Ⓐb", "a\u00a0b", "a\x0bb", "a\u200db", "a\u203fb", "a_b", "!", ""]
    rows = [(i, w and w + " and more") for i, w in enumerate([*words, None])]
    equals_sql_on(spark, tmp_path, "alias_dedup", "benchmark", rows, "item_id long, text string")


def test_question_shapes_at_other_letters(spark, tmp_path):
    """Words before and after letters outside ASCII, the long s and the Kelvin sign, white space of all kinds, no text."""
    shapes = ["que, {}", "when {}", " how many day\u017f {}", "how many wee\u212as{}", "how\x0bold {}", "how\u00a0long", "how\nold", "\x0bis", "é{}", "{}é", "x, \u017fhould {}", "ñ" * 60 + ", {}", "ñ" * 61 + ", {}", "a\nb, {}", ""]
    texts = [x.format(y) for x in shapes for y in ("do", "doñado", "éis", "i\u017f", "IS", "ıs", "İs", "do\u0301", "or", "ñor", "orñ", "do_", "do1", "do\u0661")]
    rows = [(i, n, t) for n in range(5) for i, t in enumerate([*texts, None])]
    equals_sql_on(spark, tmp_path, "question_shapes", "conversations", rows, "conv_id long, turn long, text string")


def shuffled_rows(spark, df):
    """Rows that the stages of a result write to shuffles."""
    gateway = spark.sparkContext._gateway

    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for s, n in stages().items() if s not in before)


@pytest.fixture(scope="module")
def many_vectors(spark, tmp_path_factory):
    """2,000 vectors, 100 of which ask; a third are copies of one, so that ranks are decided by ids."""
    path = tmp_path_factory.mktemp("vectors")
    rng = random.Random(3)
    one = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, one if i % 3 == 1 else [rng.gauss(0, 1) for _ in range(64)], i % 10) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


#: Rows that may be shuffled over ``many_vectors``; there are 200,000 pairs of a question and a vector.
@pytest.mark.parametrize("name, most", [("strict_hierarchy_topk", 10_000), ("prf_rocchio", 60_000), ("rerank_fusion", 20_000), ("soft_episode_score", 120_000), ("turn_selection", 200_000), ("linear_memory_rank", 10_000), ("coarse_to_fine", 60_000)])
def test_pairs_are_not_shuffled(spark, many_vectors, name, most):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{many_vectors}/embeddings.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, many_vectors)
    want = con.sql(__spark_entry__.oracle_sql()[name]).select(*df.columns).fetchall()
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in want)
    assert shuffled_rows(spark, __spark_entry__.queries()[name](spark, many_vectors)) < most


def test_turns_of_alike_scores(spark, tmp_path):
    """Turns so far behind that many ranks give one score, in episodes that are chosen all the same: the smaller turn goes first."""
    rng = random.Random(5)

    def vector(i):
        near = i % 50 in (1, 3, 5)
        angle = 0.01 * (i % 50) if i < 50 else 2.8 + 0.01 * (i % 50) if near else 0.02 * (i % 50)
        return [math.cos(angle), math.sin(angle), round(rng.uniform(-0.3, 0.3), 2)]

    ids = [*range(50), *range(51, 140_000, 2)]
    spark.createDataFrame([(i, vector(i), 0) for i in ids], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = __spark_entry__.queries()["turn_selection"](spark, str(tmp_path))
    want = con.sql(__spark_entry__.oracle_sql()["turn_selection"]).select(*df.columns).fetchall()
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in want)
    # these episodes' turns take part, from places where scores are alike
    assert any(r[df.columns.index("episode")] in (1, 3, 5) for r in want)


def test_sessions_are_scored_as_blocks(spark, many_vectors):
    """Cosines come from matrix products, not from a join that folds two arrays for each pair of rows."""
    plan = __spark_entry__.queries()["linear_memory_rank"](spark, many_vectors)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
    assert "zip_with" not in plan
