import random

from graphloom.llm import latex, leakage


def brute(docs, items, least):
    out = set()
    for i, t in items:
        iw = latex.words(t or "")
        grams = {tuple(iw[j : j + least]) for j in range(len(iw) - least + 1)}
        for d, x in docs:
            dw = latex.words(x or "")
            if grams & {tuple(dw[j : j + least]) for j in range(len(dw) - least + 1)}:
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, words string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


def test_like_brute_force_on_random_words(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(6)}"
    items = [(n, " ".join(word() for _ in range(rng.randrange(3, 40)))) for n in range(12)]
    docs = [(n, " ".join(word() for _ in range(200))) for n in range(30)]
    docs += [(100 + n, f"fill {rng.choice(items)[1].upper()} % fill") for n in range(10)]
    for least in (3, 5, 12):
        got = [(r.doc_id, r.item_id) for r in leakage.matched(*frames(spark, docs, items), least).collect()]
        assert set(got) == brute(docs, items, least) and len(got) == len(set(got))


def test_several_automata_nulls_and_ties(spark, monkeypatch):
    text = " ".join(f"a{i}" for i in range(14))
    items = [(1, text), (2, text), (3, None), (4, ""), (5, "short one"), (None, text), (1, text)]
    docs = [(10, "x " + text), (11, None), (12, ""), (13, text.replace("a6", "b")), (14, "and " + text.replace(" ", "\n% "))]
    want = {(d, i) for d in (10, 14) for i in (1, 2)}
    assert {(r.doc_id, r.item_id) for r in leakage.matched(*frames(spark, docs, items)).collect()} == want
    monkeypatch.setattr(leakage, "AUTOMATON_CHARS", 40)
    assert {(r.doc_id, r.item_id) for r in leakage.matched(*frames(spark, docs, items)).collect()} == want


def test_places_and_coverage(spark):
    text = " ".join(f"a{i}" for i in range(20))
    body = "p q " + text + " z " + " ".join(f"a{i}" for i in range(13))
    found = leakage.matched(*frames(spark, [(1, body)], [(7, text)]))
    assert sorted(tuple(r) for r in leakage.spans(found).collect()) == [(1, 7, 2, 21), (1, 7, 23, 35)]
    r = leakage.leaks(found).first()
    assert (r.spans, r.span_words, r.longest, r.windows, r.item_coverage) == (2, 33, 20, 11, 1.0) and abs(r.doc_coverage - 33 / 36) < 1e-12


def brute_cleaned(text, items, least, most_words, most_coverage):
    """The words that stay, by windows compared one by one."""
    ws, gone = latex.words(text), set()
    for item in items:
        iw = latex.words(item)
        grams = {tuple(iw[j : j + least]) for j in range(len(iw) - least + 1)}
        covered = sorted({k for j in range(len(ws) - least + 1) if tuple(ws[j : j + least]) in grams for k in range(j, j + least)})
        spans, n = [], 0
        for k in covered:
            if spans and k == spans[-1][1] + 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        n = sum(b - a + 1 for a, b in spans)
        gone |= {k for a, b in spans if n > most_coverage * len(iw) or b - a + 1 > most_words for k in range(a, b + 1)}
    return [w for k, w in enumerate(ws) if k not in gone], len(gone)


def test_removal_like_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(7)}"
    items = [(n, " ".join(word() for _ in range(rng.randrange(4, 60)))) for n in range(8)]
    docs = [(n, "\\newcommand{\\mac}{w1 w2 W3}\\emph{" + " ".join(rng.choice([word(), word(), word() + ",", "\\mac{}", "% x\n", "\\cite{w1}"]) for _ in range(60)) + "}") for n in range(12)]
    docs += [(50, "start " + items[0][1] + " end"), (51, "nothing here"), (52, None), (53, "")]
    for least, most, share in ((3, 5, 0.9), (4, 100, 0.2), (3, 3, 2.0)):
        got = {r.doc_id: r for r in leakage.cleaned(*frames(spark, docs, items), least, most, share).collect()}
        for n, text in docs:
            kept, gone = brute_cleaned(text or "", [t for _, t in items], least, most, share)
            assert (n in got) == (gone > 0)
            if gone:
                r = got[n]
                assert r.removed_words == gone and r.doc_words == len(latex.words(text)) and r.text.count("{") == r.text.count("}")
                if "mac" not in text:
                    assert latex.words(r.text) == kept


def test_located_words():
    text = "\\newcommand{\\m}[1]{big #1 dog}\\emph{The \\m{red}s} \u00c9t\u00e9 e\u0301 \\cite{k} pre\\m{x}"
    whole, found, starts, ends = latex.located(text)
    assert found == latex.words(text)
    assert [whole[a:b] for a, b in zip(starts, ends)][:3] == ["The", "\\m{red}", "\\m{red}"] and whole[starts[-2] : ends[-2]] == "\\m{x}"
    assert latex.without_words("one, two. three", [(0, 0), (2, 9)]) == (", two. ", 2, 3)


def test_automaton_is_small():
    rng = random.Random(1)
    items = [(n, [f"w{rng.randrange(3000)}" for _ in range(100)]) for n in range(300)]
    a = leakage.Automaton(items)
    chars = sum(len(" ".join(ws)) for _, ws in items)
    assert a.bytes_held() < 40 * chars
    assert set(a.matches(items[5][1])) == {5}


def test_empty_tables(spark):
    assert leakage.matched(*frames(spark, [], [(1, "a " * 20)])).count() == 0
    assert leakage.matched(*frames(spark, [(1, "a " * 20)], [])).count() == 0


def test_whole_small_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    got = {(r.doc_id, r.item_id) for r in leakage.matched(docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 12)
