"""Functions and operators outside the query oracles: goldens, invariants, sources and streaming."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import dates, models, prompts, text, udfs
from lorewell.functions import vectors as V
from lorewell.operators import classifier, graph, loop, memory, ranking, segments
from lorewell.plans import evidence_loop, memory_queries
from lorewell.sources import readers, writers
from lorewell.streaming import memory_stream

STAMP = "1:56 pm on 8 May, 2023"


SAID = [
    ("I went yesterday.", STAMP, "I went yesterday (7 May, 2023)."),
    ("last month", "2023-05-08", "last month (2023-04)"),
    ("I go running on Fridays.", STAMP, "I go running on Fridays."),
    ("see you on Friday, I will come", STAMP, "see you on Friday (the Friday after 8 May, 2023), I will come"),
    ("We met on Friday.", "May 8 2023", "We met on Friday (the Friday before May 8 2023)."),
    ("We met on Friday. I will come.", "May 8 2023", "We met on Friday (the Friday before May 8 2023). I will come."),
    ("the 31st", "3 May, 2023", "the 31st"),
    ("we did it the 5th, or the 30th?", STAMP, "we did it the 5th (5 May, 2023), or the 30th (30 April, 2023)?"),
    ("three days ago and last winter", STAMP, "three days ago (5 May, 2023) and last winter"),
    ("the day before yesterday", STAMP, "the day before yesterday (6 May, 2023)"),
    ("last summer", STAMP, "last summer (the summer of 2022)"),
    ("next spring and this fall", STAMP, "next spring (the spring of 2024) and this fall (the fall of 2023)"),
    ("on the 5th of June", STAMP, "on the 5th of June"),
    ("in the 5th grade", STAMP, "in the 5th grade"),
    ("Two weekends ago, this past weekend, over the weekend", "2023-05-08", "Two weekends ago (Two weekends before 2023-05-08), this past weekend (the weekend before 2023-05-08), over the weekend (the weekend before 2023-05-08)"),
    ("a few days ago; the other day", STAMP, "a few days ago (a few days before 8 May, 2023); the other day (a few days before 8 May, 2023)"),
    ("9 months ago", STAMP, "9 months ago (August 2022)"),
    ("an Year ago, next  month", STAMP, "an Year ago (2022), next  month"),
    ("yesterday (7 May, 2023)", STAMP, "yesterday (7 May, 2023)"),
    ("yesterday", None, "yesterday"),
    ("yesterday", "31 February 2023", "yesterday"),
    (None, STAMP, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(SAID)], "i int, said string, stamp string, want string")
    once = df.withColumn("r", dates.resolved(F.col("said"), F.col("stamp"))).withColumn("again", dates.resolved(F.col("r.text"), F.col("stamp")))
    for row in once.collect():
        assert row.r.text == row.want and (row.r.n > 0) == (row.want != row.said), row
        assert tuple(row.again) == (row.r.text, 0)


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "libraries": "librari", "library": "librari", "hopping": "hop", "relational": "relat", "adoption": "adopt", "agencies": "agenc", "agency": "agenc", "sky": "sky", "formalize": "formal", "running": "run"}
    assert {w: text.porter(w) for w in want} == want


def test_ranking_is_a_permutation(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(20)], "question int, item int, score double")
    got = ranking.ranked(df, "question", [F.desc("score"), F.asc("item")], "r").collect()
    assert sorted(r.r for r in got) == list(range(20))


def test_gap_cut_needs_three_gaps(spark):
    rows = [("few", i, s) for i, s in enumerate((0.9, 0.1, 0.05))] + [("cut", i, s) for i, s in enumerate((0.9, 0.88, 0.2, 0.19, 0.18))]
    got = ranking.gap_cut(spark.createDataFrame(rows, "q string, place int, s double"), "q", "s", "place")
    assert {(r.q, r.place) for r in got.collect()} == {("few", 0), ("few", 1), ("few", 2), ("cut", 0), ("cut", 1)}


def naive_modularity(m, t):
    n, total = len(m), m.sum()
    k = m.sum(0)
    return sum(m[i, j] - k[i] * k[j] / total for i in range(n) for j in range(n) if (i < t) == (j < t)) / (2 * total)


def test_split_scores_equal_the_naive_ones():
    m = np.random.default_rng(1).random((12, 12))
    m = m + m.T
    got = segments.modularity_split(m, 1, 11)
    assert np.allclose(got, [naive_modularity(m, t) for t in range(1, 11)])
    for t, c in zip(range(1, 11), segments.modularity_split(m, 1, 11, "conductance"), strict=True):
        parts = []
        for a in (slice(0, t), slice(t, None)):
            inside = m[a, a].sum()
            cut = m[a].sum() - inside
            parts.append(cut / min(inside, m.sum() - inside))
        assert np.isclose(c, min(parts))


def test_chunks_keep_every_word():
    random.seed(1)
    body = "\n\n".join(" ".join(f"w{random.randrange(99)}" for _ in range(random.choice((5, 90, 400)))) for _ in range(12))
    got = segments.chunk_document(body)
    assert " ".join(got).split() == body.split()
    assert all(len(p.split()) <= 300 for p in got)
    assert segments.chunk_document("  \n ") == []


def test_delta_fold_invariants():
    rng = np.random.default_rng(2)
    q, k, v = rng.random((3, 6, 4))
    g = [np.full((6, 4), x) for x in (0.9, 0.2, 0.5)]
    start = rng.random((4, 4))
    reads, s = memory.delta_fold(q, k, v, *g, np.zeros(6, bool), start)
    assert np.allclose(s, start) and not reads.any()
    reads, s = memory.delta_fold(q, k, v, *g, np.ones(6, bool), start)
    assert np.allclose(reads[0], start @ q[0])
    half, mid = memory.delta_fold(q[:3], k[:3], v[:3], *[x[:3] for x in g], np.ones(3, bool), start)
    rest, end = memory.delta_fold(q[3:], k[3:], v[3:], *[x[3:] for x in g], np.ones(3, bool), mid)
    assert np.allclose(np.concatenate([half, rest]), reads) and np.allclose(end, s)


def test_delta_rule_fold_covers_every_user(spark, tmp_path):
    """The registered query against the loop, users beyond the first twenty too."""
    rows = [(i, datetime.datetime(2024, 1, 1), u, "view", 0.37 * i + u) for i, u in enumerate([3, 19, 20, 3, 500, 20, 19, 500, 500, 3, 20, 500])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for user in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == user]
        q, k, v = (np.array([[np.sin(r[4] * (p + i)) for i in range(4)] for r in own]) for p in (1, 2, 3))
        gates = [np.full((len(own), 4), x) for x in (0.9, 0.1, 0.5)]
        reads, s = memory.delta_fold(q, k, v, *gates, np.array([r[0] % 5 > 0 for r in own]))
        want |= {(user, n + 1): (np.linalg.norm(x), np.linalg.norm(s)) for n, x in enumerate(reads)}
    found = {(r.user_id, r.step): (r.read_norm, r.state_norm) for r in memory_queries.delta_rule_fold(spark, f"file://{tmp_path}").collect()}
    assert found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k], atol=1e-6) for k in want)


def test_mixture_gate_keeps_the_upper_scores():
    scores = np.array([0.1, 0.12, 0.11, 0.09, 0.9, 0.92, 0.95])
    assert 6 in memory.gate_accepts(scores) and set(memory.gate_accepts(scores)) <= {4, 5, 6}
    assert memory.gate_accepts(np.array([])) == [] and memory.gate_accepts(np.array([0.3])) == [0]


def test_ward_and_greedy_clusters():
    v = np.array([[0, 1], [0.1, 1], [5, 0], [5, 0.1], [0, 1.1]])
    assert memory.ward(v, 2) == [0, 0, 1, 1, 0]
    assert memory.greedy_clusters(v, 0.9) == [0, 0, 1, 1, 0]


def test_dialogue_source(spark, tmp_path):
    turn = lambda s, t, **k: {"speaker": s, "dia_id": "D1:1", "text": t, **k}
    sample = {
        "sample_id": "a",
        "conversation": {"speaker_a": "A", "session_10": [turn("B", "ten")], "session_10_date_time": "10 May, 2024", "session_2": [turn("A", "two", blip_caption="a cat"), turn("B", "three")], "session_2_date_time": "2 May, 2024"},
        "qa": [{"question": "q1", "answer": "x", "category": 1, "evidence": ["D1:1"]}, {"question": "q2", "category": 5, "adversarial_answer": "y"}, {"question": "q3", "category": 2}],
    }
    path = tmp_path / "dev_2q.json"
    path.write_text(json.dumps([sample]))
    samples = readers.read_samples(spark, f"file://{path}")
    turns = readers.session_turns(samples).orderBy("seq").collect()
    assert [(r.session_no, r.text, r.time) for r in turns] == [(2, "two [shared an image: a cat]", "2 May, 2024"), (2, "three", "2 May, 2024"), (10, "ten", "10 May, 2024")]
    assert readers.session_turns(samples, 1).count() == 1
    asked = readers.questions(samples)
    assert {(r.question, r.answer) for r in asked.collect()} == {("q1", "x"), ("q2", "y")}
    assert readers.check_question_count(asked, str(path)).count() == 2
    with pytest.raises(ValueError):
        readers.check_question_count(asked.limit(1), str(path))
    assert readers.questions(samples, [1]).count() == 1


def test_checkpoint_source(spark, tmp_path):
    lines = [{"q_idx": 1, "prediction": "a", "score": 0.5}, {"q_idx": 2, "prediction": ""}, {"q_idx": 3, "prediction": "", "skipped": True}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"q_idx": 4, "pred')
    done = readers.read_checkpoint(spark, f"file://{tmp_path}/r.jsonl")
    assert {r.q_idx for r in done.collect()} == {1, 3}


def test_graph_round_trip(spark, tmp_path):
    contents = spark.createDataFrame([("g1", "e0", "hello", "episodic", "1 May, 2024", ["t"], [])], "graph string, content string, text string, layer string, time string, tags array<string>, topic_links array<string>")
    links = spark.createDataFrame([("g1", "Bob", "t", "e0"), ("g1", "Ann", "t", "e0"), ("g1", "Ann", "t", "e0")], "graph string, cue string, tag string, content string")
    docs = writers.graph_documents(contents, links)
    (tmp_path / "g1.json").write_text(docs.first()["json"])
    c, back, cues = readers.read_graphs(spark, f"file://{tmp_path}/g1.json")
    assert {(r.cue, r.tag, r.content) for r in back.collect()} == {("Ann", "t", "e0"), ("Bob", "t", "e0")}
    assert c.first()["text"] == "hello" and cues.count() == 2


def test_model_stand_ins():
    assert np.allclose(models.hashed_vector("a b"), models.hashed_vector("b a"))
    assert models.Model(lambda s, u: "no json").ask("", "") == {} == models.Model(lambda s, u: 1 / 0).ask("", "")
    assert models.Model(lambda s, u: 'so: {"keep": [1]} ok').ask("", "") == {"keep": [1]}
    assert readers.index_range("0-2,5") == [0, 1, 2, 5]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = events.orderBy("ts", "event_id").limit(300)
    parts = ordered.withColumn("n", F.percent_rank().over(Window.orderBy("ts", "event_id")))
    for i in range(3):
        parts.where(f"n >= {i} / 3.0 and n < {i + 1 + (i == 2)} / 3.0").drop("n").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = memory_stream.buffer_stream(memory_stream.read_events(spark, f"file://{tmp_path}/in", 1))
    memory_stream.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = {(r.user_id, r.event_id, r.evicted) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.user_id, r.event_id, r.evicted) for r in memory.buffer_evictions(ordered, "user_id", ["ts", "event_id"], "event_id").collect()}
    assert len(got) == 300 and got == want


def parquet_parts(df, path, n=3):
    rows = df.orderBy("seq").collect()
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], df.schema).coalesce(1).write.mode("append").parquet(path)


def test_boundary_and_topic_streams(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, float(rng.random()), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "stream long, seq long, value double, vec array<double>")
    parquet_parts(df, f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    memory_stream.drain(memory_stream.boundary_stream(stream.select("stream", "seq", "value"), 0.5, 6), f"file://{tmp_path}/b", f"file://{tmp_path}/cb")
    memory_stream.drain(memory_stream.topic_stream(stream.select("stream", "seq", "vec"), 0.4), f"file://{tmp_path}/t", f"file://{tmp_path}/ct")
    got = {(r.stream, r.seq): r.boundary for r in spark.read.parquet(f"file://{tmp_path}/b").collect()}
    topics = {(r.stream, r.seq): r.topic for r in spark.read.parquet(f"file://{tmp_path}/t").collect()}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        for n, r in enumerate(own):
            before = [x[2] for x in own[max(0, n - 6) : n]]
            assert got[s, r[1]] == (len(before) >= 2 and r[2] > np.mean(before) + 0.5 * np.std(before, ddof=1))
        assert [topics[s, r[1]] for r in own] == memory.greedy_clusters(np.array([r[3] for r in own]), 0.4)


def test_blocked_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_BLOCK", 7)
    monkeypatch.setattr(ranking, "_STEP", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], "ab"[i % 2]) for i in range(60)] + [(99, None, "a"), (98, [0.0, 0.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "item long, vec array<double>, label string")
    q = df.where("item % 5 = 0").select(F.col("item").alias("question"), F.col("vec").alias("q_vec"), "label")
    pairs = q.crossJoin(df.where("vec IS NOT NULL").withColumnRenamed("label", "other")).where("question <> item").withColumn("sim", F.round(V.cosine(F.col("q_vec"), F.col("vec")), 9))
    pick = lambda d: sorted((r.question, r.item, r.sim, r["rank"]) for r in d.collect())
    order = [F.desc("sim"), F.asc("item")]
    assert pick(ranking.nearest(q, df, 4)) == pick(ranking.top(pairs, "question", order, 4))
    assert pick(ranking.nearest(q, df, 3, label="label")) == pick(ranking.top(pairs.where("label <> other"), "question", order, 3))
    assert pick(ranking.nearest(q, df, 2, part=F.col("label"), least=0.1)) == pick(ranking.top(pairs.where("sim >= 0.1"), ["question", "other"], order, 2))
    assert ranking.similarities(q, df).count() == pairs.count()


def test_probes_are_found_inside_texts(spark):
    texts = ["one two three four five six seven eight nine", "xone two threex", "a concatenation of words", "nothing", ""]
    probes = ["two three four five six seven", "ne two three", "cat", "one two three", "six seven eight nin", "of words", "two three four five six seven eighty"]
    p = spark.createDataFrame(list(enumerate(probes)), "item_id int, probe string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, c string")
    want = {(i, d) for i, x in enumerate(probes) for d, c in enumerate(texts) if x in c}
    assert {tuple(r) for r in graph.holding(p, t).collect()} == want


def test_loop_by_a_plain_loop(spark):
    """The batched search against one question at a time."""
    said = {0: ["Ann likes Rome and old maps", "Bob was in Paris in spring", "Rome was warm", "maps of Paris are rare", "Ann met Bob", "Ann likes Rome and old maps"], 1: ["Carl sings", "nothing here", "Carl and Dora dance"]}
    asked = {0: "Where did Ann find maps of Lisbon", 1: "Does Carl dance"}
    contents = [(g, f"e{i}", i, t) for g, ts in said.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(contents, "graph long, content string, place long, text string")
    links = graph.build_links(df.withColumn("role", F.lit("x")), graph.capitalised(F.col("text")), F.col("role"))
    questions = spark.createDataFrame([(g, "q", t) for g, t in asked.items()], "graph long, question string, text string")
    evidence, trajectory = evidence_loop.run_loop(df, links, questions)
    got, steps = {g: [] for g in said}, {g: [] for g in said}
    for r in evidence.orderBy("round", "place").collect():
        got[r.graph].append((r.round, r.content))
    for r in trajectory.orderBy("iteration").collect():
        steps[r.graph].append((r.n_candidates, r.n_kept, r.mode, r.gaps, r.step))
    import re

    cues_of = lambda t: re.findall(r"\b[A-Z][a-z]{2,}", t) or ["Unknown"]
    tokens = lambda t: set(re.findall(r"[a-z0-9]+", t.lower()))
    for g, question in asked.items():
        query, gaps, held, seen, stuck, want, path = question, [], [], set(), 0, [], []
        for r in range(1, loop.ROUNDS + 1):
            active = {c for t in said[g] for c in cues_of(t) if tokens(c) <= tokens(query) or c.lower() in query.lower()}
            # fewer than ROUND: the order does not decide
            shown = [i for i, t in enumerate(said[g]) if i not in seen and active & set(cues_of(t))]
            reply = json.loads(models.by_rules("routing", json.dumps({"question": question, "evidence": held, "gaps": gaps, "candidates": [{"id": f"e{i}", "text": said[g][i]} for i in shown]})))
            if reply["kept_content_ids"] == "ALL":
                kept, mode = shown[: loop.FAIL_OPEN], "fail_open_all"
            else:
                kept, mode = [int(x[1:]) for x in reply["kept_content_ids"]], "explicit"
            for i in sorted(kept):
                if said[g][i] not in held:
                    held.append(said[g][i])
                    want.append((r, f"e{i}"))
            gaps = [x for x in gaps if x not in reply["resolved_gaps"]] + [x for x in reply["new_gaps"] if x not in gaps]
            stuck = 0 if kept else stuck + 1
            seen |= set(shown)
            step = "answer" if r >= loop.ROUNDS or not gaps or stuck >= loop.STUCK else "retrieve"
            path.append((len(shown), len(kept), mode, len(gaps), step))
            if step == "answer":
                break
            query = f"{question} | {reply['next_query']}" if reply["next_query"] else query
        assert got[g] == want and steps[g] == path


def test_failing_model_ends_no_run(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    broken = models.Model(lambda system, user: 1 / 0)
    r = df.select(loop.chosen_actions(broken.reply("x", F.col("t"))).alias("r")).first().r
    assert tuple(r.actions) == loop.ACTIONS and not r.parsed


def test_prompts(spark):
    df = spark.createDataFrame([("When did it begin?",), ("Is it so?",), ("Who?",)], "q string")
    guided = [r[0] for r in df.select(prompts.qa_prompt(F.col("q"), F.lit("SYSTEM"), F.lit(True))).collect()]
    assert all(g.startswith("SYSTEM\n\n") and prompts.NO_REFUSAL in g for g in guided)
    assert [prompts.DATED_TIME in g for g in guided] == [True, False, False] and [prompts.YES_NO in g for g in guided] == [False, True, False]
    assert df.select(prompts.qa_prompt(F.col("q"), guided=False)).first()[0] == "Question: When did it begin?\nShort answer:"


def test_session_snapshot_and_json(spark, tmp_path):
    messages = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "ho", 1), (2, 0, "user", "x", 0)], "session long, place int, role string, content string, message_id int")
    state = spark.createDataFrame([(1, "a", "b")], "session long, key string, value string")
    path = f"file://{tmp_path}/snap"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_session(spark, path)
    for _ in range(2):  # again over what is there
        writers.write_session(messages, state, path)
    m, s = readers.read_session(spark, path)
    assert sorted(map(tuple, m.select(*messages.columns).collect())) == sorted(map(tuple, messages.collect())) and s.count() == 1
    writers.write_json(spark, f"file://{tmp_path}/x.json", {"b": [1, "é"]})
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": [1, "é"]} and not list(tmp_path.glob("*.part"))
    writers.write_sections(messages.withColumnRenamed("role", "section"), f"{path}-s")
    assert spark.read.json(f"{path}-s").groupBy("section").count().count() == 2
    assert [r.line for r in writers.report(state, ["session", "key"], [4, 3]).collect()] == ["1    a"]


def test_udfs(spark):
    udfs.register(spark)
    df = spark.createDataFrame([("a b", "g"), ("a b", "g"), (None, "h")], "t string, k string")
    df.createOrReplaceTempView("said")
    rows = spark.sql("SELECT k, lw_mean_vector(lw_encode(t)) AS v FROM said GROUP BY k ORDER BY k").collect()
    assert np.allclose(rows[0].v, models.hashed_vector("a b")) and not any(rows[1].v)
    assert [tuple(r) for r in spark.sql("SELECT no, passage FROM lw_passages('one two')").collect()] == [(0, "one two")]
    calls = df.select(udfs.encoder(lambda texts: np.array([[len(t), len(texts)] for t in texts]))(F.col("t")).alias("v")).collect()
    assert calls[0].v[0] == 3.0 and df.select(udfs.segmenter(str.split)(F.col("t")).alias("p")).first().p == ["a", "b"]


def test_classifier_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3) + 4 * (i % 3)), float(i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    parts = classifier.split(df, "id")
    assert sum(p.count() for p in parts) == 240
    model = classifier.train(parts[0], ["a", "b", "c"], hidden=(8, 4), rounds=60)
    assert classifier.accuracy(model, parts[2]) > 0.8


def test_registry(spark):
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 90
    assert __spark_entry__.entry(spark).count() > 0


def test_fused_ranks_by_counting(spark):
    """Only the heads of two lists are ranked; every place they have in the whole lists is right, ties and gaps included."""
    rng = np.random.default_rng(4)
    lists = [{(q, int(i)): float(rng.integers(0, 60)) / 4 for q in (1, 2, 3) for i in rng.choice(900, 700 if q < 3 else 4, replace=False)} for _ in "ab"]
    frames = [spark.createDataFrame([(q, i, s) for (q, i), s in x.items()], "question long, item long, score double") for x in lists]
    got = {(r.question, r["rank"]): (r.item, r.score) for r in ranking.fused_top(frames, 900, 100, 10).collect()}
    want = {}
    for q in (1, 2, 3):
        place = [{i: n for n, (_, i) in enumerate(sorted((-s, i) for (p, i), s in x.items() if p == q))} for x in lists]
        scores = [(-round(sum(1 / (60 + x.get(i, 900)) for x in place), 9), i) for i in {*place[0], *place[1]}]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:10])}
    assert got == want
