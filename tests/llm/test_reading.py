from pyspark.sql import functions as F

from loamgraph.llm import reading as R

EASY = "The dog and the cat sat on the mat. It was a big red dog and it ran to the shop. "
HARD = "The methodological consolidation of neurochemical regularities was encompassed by the characterization of autobiographical dependencies that constitutes the architecture. "
GERMAN = "Der Mechaniker löschte die größere Batterie ohne weitere Kosten und das Projekt verschob das Getriebe vor dem Sommer wegen des Wetters. "


def docs(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, level int, word string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, reading_level int, rater string")


def test_levels_follow_the_labels_and_outvote_errors(spark, rows):
    d = docs(spark, [(i, (EASY if i % 2 else HARD) * 6) for i in range(40)])
    lab = [(i, 1 if i % 2 else 4, "a") for i in range(30)] + [(30, 1, "a"), (31, None, "a"), (32, 9, "a"), (99, 2, "a"), (None, 3, "b")]
    got = dict(rows(R.reading_levels(d, labels(spark, lab + lab)), "doc_id", "level"))
    assert got == {i: 1 if i % 2 else 4 for i in range(40)}


def test_eligible(spark, rows):
    dump = "\n".join('{"event": "updated the and of", "item": "the archive", "value": 1}' for _ in range(20))
    d = docs(spark, [(1, EASY * 5), (2, GERMAN * 5), (3, EASY), (4, dump), (5, None), (6, ""), (7, "x " * 100), (None, EASY * 5), (8, EASY * 5 + "\n" + dump), (9, EASY * 3000)])
    assert rows(R.eligible(d), "doc_id") == [(1,), (8,), (9,)]


def test_no_labels_and_no_documents(spark, rows):
    d = docs(spark, [(1, EASY * 5)])
    assert rows(R.reading_levels(d, labels(spark, [])), "doc_id", "level") == [(1, 2)]
    assert R.reading_levels(d.limit(0), labels(spark, [(1, 1, "a")])).count() == 0


def test_tokens_are_counted_as_the_corpus_does(spark):
    import re

    for t in ("It cost 24.5 at the shop!?", "naïve — «quoted» text_2", "", "...", "a"):
        assert spark.range(1).select(R.token_count(F.lit(t))).first()[0] == len(re.findall(r"\w+|[^\w\s]+", t))


def test_votes(spark, rows):
    lab = labels(spark, [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 4, "a"), (2, 3, "b"), (2, 3, "c")])
    assert rows(R.votes(lab), "doc_id", "level") == [(1, 1), (2, 3)]




def test_normal_source(spark):
    df = spark.createDataFrame([("chat-session ",), ("CHAT_SESSION",), (" chat session",), (None,)], "s string")
    assert {r[0] for r in df.select(R.normal_source(F.col("s"))).collect()} == {"chat_session", None}
