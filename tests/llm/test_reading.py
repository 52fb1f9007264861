import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import reading

T = datetime(2025, 1, 1)
LABEL = "doc_id long, rater string, reading_level int, labelled_at timestamp_ntz, level int"
FILL = "the of and a in".split()


def corpus(seed=3, count=150):
    """Texts whose words come from pools of their level and below."""
    rng = random.Random(seed)
    docs = []
    for i in range(count):
        level = i % 5 + 1
        pool = [f"l{k}x{n}" for k in range(max(1, level - 1), level + 1) for n in range(40)]
        docs.append((i, level, " ".join(rng.choice(FILL) if rng.random() < 0.45 else rng.choice(pool) for _ in range(150))))
    return docs


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, 1, "x") for i, _, t in docs], "doc_id long, text string, level int, words string"), spark.createDataFrame(labels, LABEL)


def test_learns_levels_and_paths_agree(spark):
    docs = corpus()
    labels = [(i, "a", lv, T, 0) for i, lv, _ in docs if i % 3] + [(i, "b", 9, T, 0) for i, _, _ in docs if i % 2]
    d, labs = frames(spark, docs, labels)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(d, labs).collect()}
    held_out = [(i, lv) for i, lv, _ in docs if i % 3 == 0]
    assert np.mean([got[i] == lv for i, lv in held_out]) >= 0.85
    joined = {r.doc_id: r.reading_level for r in reading.reading_levels(d, labs, lexicon_words=0).collect()}
    assert joined == got  # a lexicon that is joined gives what a broadcast one gives


def test_what_is_no_article(spark):
    english = " ".join(["the old cat sat on a mat and it was in the sun of a day"] * 4)
    docs = [(1, 0, english), (2, 0, None), (3, 0, " \n"), (4, 0, "Withdrawn; see the newer version."), (5, 0, "der alte kater sass auf der matte und es war sonnig " * 5), (6, 0, "% " + english), (7, 0, "$" + english + "$")]
    d, labs = frames(spark, docs, [(1, "a", 2, T, 0), (None, "a", 2, T, 0), (1, None, None, None, 0)])
    assert [tuple(r) for r in reading.reading_levels(d, labs).collect()] == [(1, 2)]


def test_without_labels_or_documents(spark):
    docs = corpus(count=3)
    d, labs = frames(spark, docs, [])
    assert {tuple(r) for r in reading.reading_levels(d, labs).collect()} == {(0, 3), (1, 3), (2, 3)}
    d, labs = frames(spark, [], [(1, "a", 2, T, 0)])
    assert reading.reading_levels(d, labs).count() == 0


def test_many_labels_meet_words_instead_of_texts(spark, monkeypatch):
    docs = corpus(count=60)
    d, labs = frames(spark, docs, [(i, "a", lv, T, 0) for i, lv, _ in docs if i % 3 or not i] + [(10**12, "a", 1, T, 0)])
    want = {tuple(r) for r in reading.reading_levels(d, labs).collect()}
    monkeypatch.setattr(reading, "BROADCAST_LABELS", 0)
    got = {r.doc_id for r in reading._labelled(d.select("doc_id", "text"), reading.consensus(labs)).collect()}
    assert got == {i for i, _, _ in docs if i % 3 or not i}
    assert {tuple(r) for r in reading.reading_levels(d, labs).collect()} == want


def test_language_is_learned(spark):
    """No list of words: whatever most labelled texts are written in is the language."""
    german = "der alte kater sass auf der matte und es war sonnig an diesem tag im garten hinter dem haus"
    english = "the old cat sat on a mat and it was in the sun on that day in the garden behind the house"
    for own, other in ((german, english), (english, german)):
        docs = [(1, 0, own + " " + own[::-1].replace(" ", " x")), (2, 0, " ".join(sorted(own.split()))), (3, 0, other), (4, 0, own)]
        d, labs = frames(spark, docs, [(4, "a", 2, T, 0), (2, "a", 2, T, 0)])
        assert {2, 4} <= {r.doc_id for r in reading.reading_levels(d, labs).collect()} and 3 not in {r.doc_id for r in reading.reading_levels(d, labs).collect()}


def test_consensus(spark):
    t2 = datetime(2025, 1, 2)
    rows = [(1, "a", 1, T, 0), (1, "a", 3, t2, 0), (1, "b", 4, T, 0), (2, "a", 0, T, 0), (3, "a", 2, T, 0), (3, "a", 2, T, 0), (3, "b", 5, T, 0), (3, "c", 5, T, 0), (4, None, 2, None, 0)]
    got = {r.doc_id: r.level for r in reading.consensus(spark.createDataFrame(rows, LABEL)).collect()}
    assert got == {1: 4, 3: 5, 4: 2}


def test_held_out_accuracy(spark):
    from pathlib import Path

    import pytest

    d = "/root/testdata/sf0.1"
    if not Path(d).exists():
        pytest.skip("no test data here")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    named = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    got = reading.reading_levels(named, labels.where(~test)).join(reading.consensus(labels.where(test)), "doc_id").collect()
    assert len(got) > 100
    assert np.mean([r.reading_level == r.level for r in got]) > 0.8
    assert np.mean([abs(r.reading_level - r.level) <= 1 for r in got]) > 0.98
