"""The string kernel against brute force, held-out accuracy, planted insults and odd rows."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from sylvaflow.llm import toxicity as tox
from sylvaflow.llm.queries import op11_toxicity
from sylvaflow.llm.toxicity import toxicity

MIDDLE = "/root/testdata/sf0.1"
INSULTS = ["grobnik", "flarzel", "wompash"]


def symbols(word):
    return tox.words([word])[0]


def counted(word):
    """Subsequence counts of a word, spelt out."""
    row = [tox.MARK, *(int(c) for c in symbols(word)[0] if c), tox.MARK]
    out = {}
    for n in (3, 4):
        for start in range(len(row)):
            for rest in combinations(range(start + 1, min(len(row), start + n + 2)), n - 1):
                key = tuple(row[k] for k in (start, *rest))
                out[key] = out.get(key, 0) + tox.DECAY ** (rest[-1] - start + 1 - n)
    return out, 1 / np.sqrt(sum(max(0, len(row) - o[-1]) * tox.DECAY ** (2 * s) for o, s in tox.GAPS))


def test_kernel_and_folded_weights_are_those_of_brute_force():
    some = ["idiot", "id", "a", "statistics", "banana", "xidixotx", "abcdefghijklmnopqrstuvwx"]
    rows = np.concatenate([symbols(w) for w in some])
    want = np.array([[sa * sb * sum(v * b.get(u, 0) for u, v in a.items()) for b, sb in map(counted, some)] for a, sa in map(counted, some)])
    assert np.allclose(tox.kernel(rows, rows), want, atol=1e-4)
    amounts = np.array([0.5, -1, 2, 0.1, -0.3, 1, 0.7])
    assert np.allclose(tox.word_scores(rows, tox._folded(rows, amounts)), want @ amounts, atol=1e-3)


def test_reading():
    one = symbols("idiot")[0].tolist()
    for written in ("I.D.I.O.T", "i d i o t", "ïdïot!!", "1d1ot", "**idiot**"):
        assert [r.tolist() for r in symbols(written)] == [one]
    assert len(symbols("two words")) == 2 and len(symbols("...")) == 0
    long = symbols("x" * 100)
    assert len(long) == 1 + (100 - tox.STRIDE - 1) // tox.STRIDE and (long[0] > 0).all()
    text = "ab cd " * 200_000
    assert sum(len(tox.words(p)[0]) for _, p in tox.segments([text])) == 400_000


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    parts = "ta re mi lo su na ve ko di pe".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    def written(w):
        how = rng.randint(0, 4)
        k = rng.randint(1, len(w) - 1)
        return [w, w.upper() + "!", w[:k] + "x" + w[k:], ".".join(w), w[:k] + w[k - 1] + w[k:]][how]
    docs, labels = [], []
    for i in range(1500):
        text = [word() for _ in range(rng.randint(20, 120))]
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), written(rng.choice(INSULTS)))
        docs.append((i, " ".join(text) + "."))
        labels.append((i, toxic))
    return docs, labels


def test_gapped_and_altered_insults_on_held_out_documents(spark, planted):
    docs, labels = planted
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(frame, marks).collect()
    truth = dict(labels)
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    found = sum(r.predicted and truth[r.doc_id] for r in out)
    assert found >= 0.93 * sum(truth[r.doc_id] for r in out) and sum(r.predicted and not truth[r.doc_id] for r in out) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_the_held_out_fifth_are_never_used(spark, planted):
    docs, labels = planted
    frame = spark.createDataFrame(docs[:400], "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels[:400]]
    a, b = ({r.doc_id: r.score for r in toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels[:400], turned))
    assert a == b


def test_held_out_accuracy_of_the_table(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op11_toxicity(spark, MIDDLE).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in got if not labels[r.doc_id]]
    toxic = [r for r in got if labels[r.doc_id] and lang[r.doc_id] == "en"]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)  # some labelled texts hold no insult


def test_odd_rows_and_empty_tables(spark, planted):
    docs, labels = planted
    rows = [(*d, "en", 1, 2.0) for d in docs[:200]] + [(9001, None, None, None, None), (9002, "", "xx", 1, 1.0), (None, "grobnik flarzel", "en", 1, 1.0), (9003, " \n\t...", "en", 1, 1.0), (9004, "ta re " * 300_000 + "grobnik", "en", 1, 1.0), (9005, "z" * 700_000, "en", 1, 1.0), (9002, "", "xx", 1, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score double")
    marks = spark.createDataFrame([*labels[:200], *labels[:20], (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    got = toxicity(frame, marks).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[None].predicted == 1 and by_id[None].held_out is False
    assert by_id[9001].score == by_id[9002].score == by_id[9003].score < 0.5 and by_id[9004].predicted == 1
    assert toxicity(frame.limit(0), marks).count() == 0
    assert {r.score for r in toxicity(frame.limit(3), marks.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity(frame.limit(3), marks.filter("toxic = 1")).collect()} == {1.0}
