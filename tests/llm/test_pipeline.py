"""The pipeline's stages against brute force on the smallest documents."""

import re

import corpus_pipeline
from lorewell.llm import simhash
from lorewell.llm.common import Scratch
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = text.translate(LOWER).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def test_stages(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    extra = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "123 !?", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        seen.append(docs)
    named, unique, apart, clean, packed = seen
    assert all(d.columns == COLUMNS for d in seen[:4])
    # language: only texts without letters go
    assert {5000, 5001, 5002}.isdisjoint({r.doc_id for r in named.collect()})
    assert named.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    # copies: the largest id of each text
    want = {r.i for r in named.groupBy("text").agg(F.max("doc_id").alias("i")).collect()}
    assert {r.doc_id for r in unique.collect()} == want
    # near copies: the smallest id of each linked group
    sets = {r.doc_id: shingles(r.text) for r in unique.collect()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in apart.collect()} == {i for i in ids if find(i) == i}
    # passages: nothing of 35 words stands twice in the input and stays
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in apart.collect()}
    count = {}
    for w in words.values():
        for k in range(len(w) - 34):
            t = tuple(w[k : k + 35])
            count[t] = count.get(t, 0) + 1
    kept = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        if not all(gone):
            kept[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    rows = clean.collect()
    assert {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in rows} == kept
    assert all(r.n_chars == len(r.text) for r in rows)
    # packing: every document once, whole
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_run_returns_the_last_stage(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.agg(F.sum("length")).first()[0] > 0


def test_columns_of_any_name_pass(spark, sf_dir, tmp_path):
    """Extra columns named as the operators name theirs, nulls in all of them."""
    names = "score lang_pred _text _id blk _blk n_words kept_text n_removed kept_sha256 _key key _row _known _digest _salt root _c0 c0 part".split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit(None).cast("string") if len(n) % 2 else F.col("doc_id"))
    docs = docs.unionByName(docs.limit(5))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns or i == 4
        made.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert i == 4 or docs.where("score IS NOT NULL OR lang_pred <> doc_id").count() == 0
    assert docs.count() > 0


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert docs.count() == 0


def test_a_stage_leaves_other_results_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    groups = simhash.near_groups(docs)
    corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert groups.count() == 50
    own = Scratch()
    with own:
        groups = simhash.near_groups(docs)
    assert groups.count() == 50 and own.paths
    own.release(spark)
    assert not own.paths


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_operators_equal_their_sql(spark, sf_dir):
    import duckdb
    from lorewell.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf_dir)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert len(rel.columns) == len(at)
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name
