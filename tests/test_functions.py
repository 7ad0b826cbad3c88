"""Closed-form values of the scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import jsons, text, vectors
from loamgraph.functions import scoring as S
from loamgraph.operators.store import merge_maps, merge_safe

AS_OF = "2025-01-15 00:00:00"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def ts(x):
    return F.lit(x).cast("timestamp")


def test_recency(spark):
    r = one(spark, *[S.recency(ts(x), AS_OF) for x in (AS_OF, "2025-01-08 00:00:00", "2025-01-01 00:00:00", "2025-02-01 00:00:00")], S.recency(F.lit(None).cast("timestamp"), AS_OF))
    assert list(r)[:4] == pytest.approx([1.0, 0.5, 0.25, 1.0]) and r[4] is None


def test_activation(spark):
    assert one(spark, S.activation(F.lit(0), ts(AS_OF), AS_OF))[0] == pytest.approx(0.5)
    assert one(spark, S.activation(F.lit(9), ts("2025-01-14 21:00:00"), AS_OF))[0] == pytest.approx(1 / (1 + math.exp(-(math.log(4) - 0.5 * math.log(4)))))


def test_hybrid_gives_weight_of_null_signals_to_the_others(spark):
    w = {"vector": 0.4, "text": 0.35, "recency": 0.25}
    none = F.lit(None).cast("double")
    r = one(
        spark, S.hybrid(w, vector=F.lit(0.9), text=F.lit(0.8), recency=F.lit(0.7)), S.hybrid(w, vector=none, text=F.lit(0.8), recency=F.lit(0.7)),
        S.hybrid(w, vector=none, text=none, recency=F.lit(0.7)), S.hybrid(w, vector=none, text=none, recency=none), S.hybrid(w, vector=F.lit(0.0), text=none, recency=F.lit(1.0)),
    )
    assert list(r) == pytest.approx([0.4 * 0.9 + 0.35 * 0.8 + 0.25 * 0.7, (0.35 * 0.8 + 0.25 * 0.7) / 0.6, 0.7, 0.0, 0.25 / 0.65])


def test_stm_boost_and_supersession(spark):
    r = one(spark, *[S.stm_boost(ts(x), AS_OF) for x in (AS_OF, "2025-01-14 23:00:00", "2025-01-14 22:00:00")], S.stm_boost(ts(AS_OF), AS_OF, 0.0))
    assert list(r) == pytest.approx([1.5, 1.25, 1.0, 1.0])
    r = one(spark, *[S.supersession(F.lit(a), F.lit(b)) for a, b in ((True, False), (False, True), (True, True), (False, False))])
    assert list(r) == [0.5, 1.2, 0.5, 1.0]


def test_weights_stay_in_bounds(spark):
    r = one(spark, S.reinforced(F.lit(1.0)), S.reinforced(F.lit(1.5)), S.reinforced(F.lit(0.8)), S.reinforced(F.lit(0.5)), S.decayed(F.lit(0.1001), 0.95), S.decayed(F.lit(0.05), 0.95), S.decayed(F.lit(1.0), 0.95))
    assert list(r) == pytest.approx([1.05, 1.5, 0.85, 0.55, 0.1, 0.05, 0.95])


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, vectors.cosine(a(1, 0), a(0, 1)), vectors.cosine(a(1, 1), a(2, 2)), vectors.cosine(a(0, 0), a(1, 1)), vectors.cosine(a(1), a(1, 1)), vectors.l2_normalize(a(3, 4)), vectors.l2_normalize(a(0, 0)))
    assert r[0] == 0 and r[1] == pytest.approx(1) and r[2] == 0 and r[3] is None and r[4] == [0.6, 0.8] and r[5] == [0.0, 0.0]


def test_trigram_similarity(spark):
    r = one(spark, *[text.trigram_similarity(F.lit(a), F.lit(b)) for a, b in (("Kafka", "Apache Kafka"), ("a b", "b a"), ("", ""), ("x", None))])
    assert r[0] == pytest.approx(6 / 13) and r[1] == 1 and r[2] == 0 and r[3] is None


def test_word_similarity(spark):
    r = one(spark, *[text.word_similar(F.lit(a), F.lit(b)) for a, b in (("John Doe", "Doe John"), ("Kafka", "Apache Kafka"), ("KAFKA", "kafka"), ("big red", "a big red car"))])
    assert list(r) == [True, False, True, True]


@pytest.mark.parametrize(
    ("raw", "name", "alias"),
    [("Fluoxetine (Prozac)", "Fluoxetine", "Prozac"), ("  apache   kafka  ", "Apache Kafka", None), ("rest api", "REST API", None), ("gRPC", "gRPC", None), ("", "", None), ("(x)", "(X)", None), ("o'brien", "O'Brien", None), ("machine-learning pipeline", "Machine-Learning Pipeline", None)],
)
def test_canonical_name(spark, raw, name, alias):
    assert tuple(one(spark, text.canonical_name(F.lit(raw)), text.bracket_alias(F.lit(raw)))) == (name, alias)


@pytest.mark.parametrize(("raw", "out"), [("RelatesTo", "RELATES_TO"), ("relates-to", "RELATES_TO"), ("relates  to", "RELATES_TO"), ("hasMember", "HAS_MEMBER"), ("x", None), ("", None), ("a" * 61, None), ("DoUpdateNodeNow", None)])
def test_edge_type(spark, raw, out):
    assert one(spark, text.edge_type_name(F.lit(raw)))[0] == out


@pytest.mark.parametrize(
    ("raw", "out"),
    [("software_tool", "SoftwareTool"), ("SOFTWARE_TOOL", "SoftwareTool"), ("software tool", "SoftwareTool"), ("SOFTWARETOOL", "SOFTWARETOOL"), ("gRPC", "GRPC"), ("DishGreg", None), ("LocationSalCapeVerde", None), ("EventDrivenArchitecture", "EventDrivenArchitecture")],
)
def test_node_type(spark, raw, out):
    assert one(spark, text.node_type_name(F.lit(raw)))[0] == out


@pytest.mark.parametrize(
    ("a", "b", "safe"),
    [("Tool", "Project", True), ("Person", "PersonRole", True), ("Drug", "Neurotransmitter", False), ("Metric", "MetricUnit", False), ("API", "Capital", False), ("Event", "EventType", True), ("Person", "Organization", False), ("", "Tool", False), (None, "Tool", False), ("X", "X", True)],
)
def test_merge_safe(spark, a, b, safe):
    assert one(spark, merge_safe(F.lit(a).cast("string"), F.lit(b).cast("string")))[0] is safe


def test_maps_and_json(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    null = F.lit(None).cast("map<string,string>")
    r = one(spark, merge_maps(m(a="1", b="2"), m(b="3")), merge_maps(null, m(b="3")), merge_maps(null, null), jsons.canonical_json(F.lit('{"b":1,"a":"é"}')), jsons.canonical_json(F.lit("no")))
    assert r[0] == {"a": "1", "b": "3"} and r[1] == {"b": "3"} and r[2] is None and r[3] == '{"a": "\\u00e9", "b": 1}' and r[4] is None


def test_names_of_schemas(spark):
    r = one(spark, text.schema_name(F.lit("Agent X!"), F.lit("My Notes")), text.is_schema_name(F.lit("ncx_a1__my_notes")), text.is_schema_name(F.lit("public")), text.purpose(F.lit("ncx_a__b__c")), text.purpose(F.lit("plain")), F.length(text.role_name(F.lit("x" * 99))))
    assert list(r) == ["ncx_agent_x__my_notes", True, False, "b__c", None, 51]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=3, max_size=3))
def test_hybrid_lies_between_its_signals(spark, values):
    v = [F.lit(x).cast("double") for x in values]
    got = one(spark, S.hybrid({"vector": 0.3, "text": 0.5, "recency": 0.2}, vector=v[0], text=v[1], recency=v[2]))[0]
    known = [x for x in values if x is not None]
    assert got == 0 if not known else min(known) - 1e-9 <= got <= max(known) + 1e-9
