"""Sources: nested dialogue files, document questions, papers, graphs, chats, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue samples of a JSON array, the conversation's values as JSON text."""
    return spark.read.option("multiLine", True).schema(schemas.SAMPLE).json(path)


def session_turns(samples: DataFrame, max_turns: int | None = None) -> DataFrame:
    """(sample_id, session_no, pos, seq, speaker, dia_id, text, time) in session order (numeric, so 10 comes after 2);
    captions follow the text of the turns that share an image. ``max_turns`` keeps a prefix of each sample."""
    entries = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    sessions = entries.where(F.col("key").rlike(r"^session_\d+$")).select("sample_id", number.cast("int").alias("session_no"), F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("time"), F.from_json("value", T.ArrayType(schemas.TURN)).alias("turns"))
    rows = sessions.select("sample_id", "session_no", "time", F.posexplode("turns").alias("pos", "t"))
    shown = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.coalesce("t.text", F.lit("")), F.lit(" [shared an image: "), "t.blip_caption", F.lit("]"))).otherwise(F.coalesce("t.text", F.lit("")))
    rows = rows.select("sample_id", "session_no", "pos", "time", F.coalesce("t.speaker", F.lit("Unknown")).alias("speaker"), "t.dia_id", shown.alias("text"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("sample_id").orderBy("session_no", "pos")) - 1)
    return rows.where(F.col("seq") < max_turns) if max_turns is not None else rows


def questions(samples: DataFrame, categories: list[int] | None = None, most: int | None = None) -> DataFrame:
    """(sample_id, q_idx, question, answer, category, evidence): the adversarial answer stands in for a missing one,
    questions without any are dropped, the first ``most`` of a sample kept."""
    rows = samples.select("sample_id", F.posexplode("qa").alias("q_idx", "qa"))
    rows = rows.select("sample_id", "q_idx", "qa.question", F.coalesce("qa.answer", "qa.adversarial_answer").alias("answer"), "qa.category", "qa.evidence").where("answer IS NOT NULL")
    if categories is not None:
        rows = rows.where(F.col("category").isin(categories))
    if most is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy("q_idx"))).where(F.col("_r") <= most).drop("_r")
    return rows


def samples_with_questions(samples: DataFrame, asked: DataFrame, most: int | None = None) -> DataFrame:
    """The first ``most`` samples by id that keep a question, as asked by questions()."""
    kept = samples.join(asked.select("sample_id").distinct(), "sample_id", "left_semi")
    return kept.orderBy("sample_id").limit(most) if most is not None else kept


def expected_questions(path: str) -> int | None:
    """The number of questions that a file name such as "dev_200q.json" promises."""
    found = re.search(r"(\d+)q", path.rsplit("/", 1)[-1])
    return int(found[1]) if found else None


def check_question_count(df: DataFrame, path: str, filtered: bool = False) -> DataFrame:
    """The rows, or an error where the file name promises another number (not checked on filtered rows)."""
    want = expected_questions(path)
    if want is not None and not filtered and (got := df.count()) != want:
        raise ValueError(f"{path} should hold {want} questions and holds {got}")
    return df


def bootstrap_split(df: DataFrame, order: str, fraction: float = 0.1) -> DataFrame:
    """Rows with ``bootstrap``: the first round(n * fraction), half to even, one at least and one left at least."""
    n = df.count()
    first = 0 if n < 2 else min(max(1, round(n * fraction)), n - 1)
    cut = df.select(order).orderBy(order).limit(first).agg(F.max(order)).first()[0] if first else None
    return df.withColumn("bootstrap", F.col(order) <= F.lit(cut) if first else F.lit(False))


def read_document_questions(spark: SparkSession, path: str) -> DataFrame:
    """document_questions() of JSON lines."""
    return document_questions(spark.read.schema(schemas.DOCUMENT_QA).json(path))


def document_questions(raw: DataFrame) -> DataFrame:
    """Rows of DOCUMENT_QA as (id, context, question, answers, length); ids and questions have fallbacks, null answers go."""
    return raw.select(F.coalesce("_id", "id", F.substring(F.md5(F.coalesce("context", F.lit(""))), 1, 16)).alias("id"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("input", "question", F.lit("")).alias("question"), F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("answers"), F.coalesce("length", F.lit(0)).alias("length"))


def doc_key(context: Column) -> Column:
    return F.substring(F.md5(context), 1, 16)


def missing_keys(wanted: DataFrame, built: DataFrame, key: str = "doc_key") -> DataFrame:
    """Distinct keys that still have no index."""
    return wanted.select(key).distinct().join(built.select(key), key, "left_anti")


def paper_text(paper: Column) -> Column:
    """Title, abstract and sections of a paper, blank lines between."""
    sections = F.transform(F.coalesce(paper["full_text"], F.array().cast(schemas.PAPER["full_text"].dataType)), lambda s: F.concat_ws("\n", s["section_name"], F.array_join(s["paragraphs"], "\n")))
    return F.concat_ws("\n\n", paper["title"], paper["abstract"], F.array_join(sections, "\n\n"))


def paper_answer(unanswerable: Column, spans: Column, free: Column, yes_no: Column) -> Column:
    """Unanswerable before spans before free text before yes or no."""
    return F.when(unanswerable, "unanswerable").when(F.size(spans) > 0, F.array_join(spans, ", ")).when(F.coalesce(free, F.lit("")) != "", free).when(yes_no.isNotNull(), F.when(yes_no, "yes").otherwise("no")).otherwise("unanswerable")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, text) of a JSON object of papers by id."""
    return papers(spark.read.option("wholetext", True).text(path))


def papers(whole: DataFrame) -> DataFrame:
    """(paper_id, text, title, abstract) of rows (value) that are such objects."""
    papers = whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schemas.PAPER))).alias("paper_id", "paper"))
    return papers.select("paper_id", paper_text(F.col("paper")).alias("text"), "paper.title", "paper.abstract")


def zipped_questions(df: DataFrame, key: str, arrays: list[str], default: str = "") -> DataFrame:
    """One row per element of parallel arrays, shorter ones filled up."""
    sizes = [F.coalesce(F.size(a), F.lit(0)) for a in arrays]
    longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    rows = df.where(longest > 0).select(key, *arrays, F.explode(F.sequence(F.lit(0), longest - 1)).alias("i"))
    return rows.select(key, "i", *[F.coalesce(F.get(a, F.col("i")), F.lit(default)).alias(a) for a in arrays])


def seeded_sample(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows in an order that the key and the seed decide (the digest of "seed|key"), numbered from 0."""
    picked = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("_h", key).limit(most)
    return picked.withColumn("eval_index", F.row_number().over(Window.orderBy("_h", key)) - 1).drop("_h")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs() of files, named by their file."""
    return graphs(spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("graph"), F.col("value").alias("json")))


def graphs(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, links, cues) of graph documents (graph, json)."""
    docs = documents.select("graph", F.from_json("json", schemas.GRAPH).alias("g"))
    contents = docs.select("graph", F.explode("g.contents").alias("content", "c")).select("graph", "content", "c.*")
    links = docs.select("graph", F.explode("g.links").alias("l")).select("graph", F.get("l", F.lit(0)).alias("cue"), F.get("l", F.lit(1)).alias("tag"), F.get("l", F.lit(2)).alias("content"))
    cues = docs.select("graph", F.explode("g.cues").alias("cue", "c")).select("graph", "cue", F.explode_outer("c.tag_set").alias("tag"))
    return contents, links, cues


def read_hypergraphs(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    """hypergraphs() of files, named by their file."""
    return hypergraphs(spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("graph"), F.col("value").alias("json")), version)


def hypergraphs(documents: DataFrame, version: int = 1) -> dict[str, DataFrame]:
    """Node and incidence tables of hypergraph documents (graph, json) of one version; others are left out, to be
    rebuilt."""
    docs = documents.select("graph", F.from_json("json", schemas.HYPERGRAPH).alias("h")).where(F.col("h.version") == version)
    part = lambda name: docs.select("graph", F.explode(f"h.{name}").alias("x")).select("graph", "x.*")
    edges = part("fact_hyperedges").unionByName(part("episode_hyperedges"))
    members = edges.select("graph", F.col("id").alias("edge"), F.coalesce("episode_id", "topic_id").alias("owner"), F.explode("relation").alias("node", "role"), "weights")
    members = members.select("graph", "edge", "owner", "node", "role", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("weights", F.col("node")), F.lit(0.5)))).alias("weight"))
    return {"topics": part("topics"), "episodes": part("episodes"), "facts": part("facts"), "members": members}


def read_chats(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """chats() of a file, of JSON lines or of one array."""
    return chats((spark.read.option("multiLine", True) if array else spark.read).schema(schemas.CHAT).json(path))


def chats(raw: DataFrame) -> DataFrame:
    """Rows of CHAT with their messages, or those that prompt and response make; rows with neither go."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    made = F.when(F.col("prompt").isNotNull() & F.col("response").isNotNull(), pair)
    kept = [c for c in raw.columns if c not in ("messages", "prompt", "response")]
    return raw.select(*kept, F.coalesce("messages", made).alias("messages")).where("messages IS NOT NULL")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Result rows that count as done: malformed lines and rows without a prediction that were not skipped go."""
    raw = spark.read.schema(schemas.RESULT).option("mode", "PERMISSIVE").json(path)
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good.where((F.coalesce("prediction", F.lit("")) != "") | F.coalesce("skipped", F.lit(False)))


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("x")).select(*key, *[f"x.{c}" for c in rest])


def resumable(records: DataFrame, todo: DataFrame) -> DataFrame:
    """Records that answer a task: same question, same first thousand characters of the prompt."""
    key = lambda df: df.withColumn("_k", F.substring("prompt", 1, 1000))
    return key(todo).select("_k", "question", "task_id").join(key(records).drop("prompt"), ["_k", "question"]).drop("_k")


def index_range(spec: str) -> list[int]:
    """Indexes of "0-3" or "1,2,5"."""
    out: list[int] = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        out += range(int(low), int(high or low) + 1)
    return out


def read_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, state) of a snapshot that was written to its end."""
    marker = spark.read.schema("version int").json(f"{path}/snapshot.json").first()
    if marker is None or marker["version"] != 1:
        raise ValueError(f"{path} holds no snapshot of version 1")
    return spark.read.parquet(f"{path}/messages"), spark.read.parquet(f"{path}/state")
