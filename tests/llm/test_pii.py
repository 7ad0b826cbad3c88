import numpy as np
import pytest

from loamgraph.llm import pii as P
from loamgraph.llm.pii_samples import Maker, held_out, plain_sentences
from loamgraph.llm.pii_training import Trainer


@pytest.fixture(scope="module")
def model():
    w, plain = P.load()
    return P.Tagger(w), plain


def found(model, text):
    return [(k, text[a:b]) for a, b, k in P.find([text], *model)[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        pytest.param("The recipe goes back to Lillian Dralistirs on Friday.", [("NAME", "Lillian Dralistirs")], marks=pytest.mark.xfail(reason="missed by the network trained on invented texts only")),
        ("Call +49 30 23125 220 about the library.", [("PHONE", "+49 30 23125 220")]),
        ("The recipe bounced from <rebecca.kazernusk (at) mail.example.org> twice.", [("EMAIL", "rebecca.kazernusk (at) mail.example.org")]),
        ("Home: Flat 39, 212 Hawkbridge Avenue, Norddorf.", [("ADDRESS", "Flat 39, 212 Hawkbridge Avenue, Norddorf")]),
        ("Their tax ID is 73/304/44672.", [("ID", "73/304/44672")]),
        ("The build 80.843.7656 passed on the second run. Ticket 864-5230-19 is still open.", []),
        ("We pinned the package lumeldomir@5.28.2 for now. Ping @atlas in the channel.", []),
        ("", []),
    ],
)
def test_spans(model, text, want):
    assert found(model, text) == want


def test_whole_long_texts_are_read(model):
    plain = "The report covered the central document because the journal was still careful. "
    text = plain * 600 + "Call 07700 900548 about the notebook. " + plain * 600 + "Met Victoria G. Drezarkamer at the release; " + plain * 10
    assert found(model, text) == [("PHONE", "07700 900548"), ("NAME", "Victoria G. Drezarkamer")]


def test_many_spans_close_together_cross_windows(model):
    text = " ".join(f"Call +1 (415) 555-01{i:02} about the library." for i in range(40))
    assert [x for _, x in found(model, text)] == [f"+1 (415) 555-01{i:02}" for i in range(40)]


def test_batches_do_not_matter(model):
    texts = ["Call 07700 900548 about it.", None, "", "Write to timothy+lab@mail.example.org for the service.", "x" * 3000, "7" * 3000, "Zoë — ☃ 𝒳 07700 900548", "\x00\ud800 a@b.example"]
    assert P.find(texts, *model) == [P.find([t], *model)[0] for t in texts]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("May Stone signed the note.", ["May Stone"]),
        ("signed off by May Hill and Mark Page", ["May Hill", "Mark Page"]),
        ("Prepared by Mark Green for the summer review.", ["Mark Green"]),
        ("Write to priya at gmail dot com", ["priya at gmail dot com"]),
        ("We met Nguyen Thi Minh Khai", ["Nguyen Thi Minh Khai"]),
        ("Ask Hannelore Vogt", ["Hannelore Vogt"]),
        ("Rose Green called.", ["Rose Green"]),
        ("M. Stone and Mark Hill", ["M. Stone", "Mark Hill"]),
        ("Siobhan O'Connor-Reyes lives here", ["Siobhan O'Connor-Reyes"]),
        ("signed Bartholomew Featherstonehaugh", ["Bartholomew Featherstonehaugh"]),
        ("Flat 3, 12 Park Road is plain.", ["Flat 3, 12 Park Road"]),
    ],
)
def test_names_and_addresses_of_plain_words(model, text, want):
    assert [x for _, x in found(model, text)] == want


def test_regions_lose_nothing(model):
    """Every labelled span of the invented texts lies in a region, but for lower-case names of plain words only."""
    maker = Maker(7, ["The report was late and the sensor was old."])
    n = lost = 0
    for _ in range(3000):
        t, spans = maker.text()
        r = P.regions(t, model[1])
        n += len(spans)
        lost += sum(not any(x <= a and b <= y for x, y in r) for a, b, _ in spans)
    assert n > 3000 and lost <= 0.002 * n


def test_held_out_accuracy(model):
    """On sentence frames and given names that the training never used."""
    import pyarrow.parquet as pq

    plain = plain_sentences([t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t])
    maker = Maker(99, plain, train=False)
    assert all(held_out(f) for f in maker.frames)
    made = [maker.text() for _ in range(2000)]
    hit = got = want = 0
    for (t, spans), s in zip(made, P.find([t for t, _ in made], *model)):
        hit, got, want = hit + len(set(spans) & set(s)), got + len(s), want + len(spans)
    assert hit / got >= 0.93 and hit / want >= 0.93


def test_placeholders_leave_the_rest(spark, rows):
    df = spark.createDataFrame([("f", 1, "Call 07700 900548 about it, or Write to a.b@mail.example.org for it."), ("f", 2, "Nothing here."), ("f", 3, None), ("f", None, "x")], "text_field string, row_id long, text string")
    out = {r["row_id"]: (r["n_found"], r["clean_text"]) for r in P.redacted(df).collect()}
    assert out == {1: (2, "Call [PHONE] about it, or Write to [EMAIL] for it."), 2: (0, "Nothing here."), 3: (0, None), None: (0, "x")}
    assert rows(P.found_spans(df), "row_id", "start_at", "found_text") == [(1, 40, "a.b@mail.example.org"), (1, 5, "07700 900548")]
    assert P.found_spans(df.limit(0)).count() == 0


def test_regions_and_windows():
    plain = frozenset({"the", "dog", "ran"})
    assert P.regions("the dog ran the dog", plain) == []
    (a, b), *_ = P.regions("the dog ran " * 20 + "Xanadu" + " the dog ran" * 20, plain)
    assert a == 240 - P.MARGIN and b == 246 + P.MARGIN
    for n in (1, 160, 161, 500, 1234):
        w = P.windows(7, 7 + n)
        assert w[0][0] == 7 and w[-1][1] == 7 + n and all(x[1] - y[0] >= P.OVERLAP for x, y in zip(w, w[1:])) and all(y - x <= P.WINDOW for x, y in w)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    t = Trainer(rng)
    codes, gold, lens = rng.integers(1, P.SYMBOLS, (6, 3)), rng.integers(0, P.LABELS, (6, 3)), np.array([6, 4, 2])
    for j, n in enumerate(lens):
        codes[n:, j] = 0
        gold[n:, j] = 0
    before = {k: v.copy() for k, v in t.p.items()}
    t.step(codes, gold, lens, 0.0)
    grads = {k: v / 0.1 for k, v in t.m.items()}
    for k in before:
        flat = np.argsort(-np.abs(grads[k]).ravel())[:3]
        for i in flat:
            x = np.unravel_index(i, before[k].shape)
            loss = []
            for e in (1e-2, -1e-2):
                t.p = {a: b.copy() for a, b in before.items()}
                t.p[k][x] += e
                loss.append(t.step(codes, gold, lens, 0.0))
            diff = (loss[0] - loss[1]) / 2e-2
            scale = abs(diff) + 1e-3
            norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
            assert abs(diff * min(1.0, 5.0 / max(norm, 1e-9)) - grads[k][x]) / scale < 0.15 or abs(diff - grads[k][x]) / scale < 0.15, (k, x, diff, grads[k][x])
