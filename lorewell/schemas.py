"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TURN = _struct(speaker=_S, dia_id=_S, text=_S, blip_caption=_S)
QA = _struct(question=_S, answer=_S, category=_I, evidence=T.ArrayType(_S), adversarial_answer=_S)
#: A dialogue sample: sessions stand under keys session_N beside session_N_date_time and the speakers, so the
#: conversation is a map whose values stay JSON text until their kind is known.
SAMPLE = _struct(sample_id=_S, conversation=T.MapType(_S, _S), qa=T.ArrayType(QA))
GRAPH = _struct(
    meta=T.MapType(_S, _S),
    cues=T.MapType(_S, _struct(tag_set=T.ArrayType(_S))),
    contents=T.MapType(_S, _struct(text=_S, layer=_S, time=_S, tags=T.ArrayType(_S), topic_links=T.ArrayType(_S))),
    links=T.ArrayType(T.ArrayType(_S)),
)
DOCUMENT_QA = _struct(_id=_S, id=_S, context=_S, input=_S, question=_S, answers=T.ArrayType(_S), length=_L)
PAPER = _struct(title=_S, abstract=_S, full_text=T.ArrayType(_struct(section_name=_S, paragraphs=T.ArrayType(_S))))
CHAT = _struct(messages=T.ArrayType(_struct(role=_S, content=_S)), prompt=_S, response=_S)
RESULT = _struct(sample_idx=_L, q_idx=_L, question=_S, category=_I, prediction=_S, score=_D, skipped=_B, _corrupt_record=_S)
FACT = _struct(id=_S, episode_id=_S, content=_S, confidence=_D, temporal=_S, spatial=_S, keywords=T.ArrayType(_S), query_patterns=T.ArrayType(_S))
EPISODE = _struct(id=_S, subject=_S, summary=_S, page_ids=T.ArrayType(_S), session=_I)
TOPIC = _struct(id=_S, title=_S, summary=_S, episode_ids=T.ArrayType(_S))
EDGE = _struct(id=_S, episode_id=_S, topic_id=_S, relation=T.MapType(_S, _S), weights=T.MapType(_S, _D))
HYPERGRAPH = _struct(version=_I, topics=T.ArrayType(TOPIC), episodes=T.ArrayType(EPISODE), facts=T.ArrayType(FACT), episode_hyperedges=T.ArrayType(EDGE), fact_hyperedges=T.ArrayType(EDGE))
