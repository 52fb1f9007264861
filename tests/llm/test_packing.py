import random
from collections import Counter

import pytest

from graphloom.llm import packing, tokens


def laid(spark, sizes, caps):
    df = spark.createDataFrame([(i, s, 1) for i, s in sizes], "doc_id long, tokens long, number int")
    return packing.packed(df.select("doc_id", "tokens"), caps, "x").collect()


def check(rows, sizes, caps):
    bins, seen = Counter(), Counter()
    kinds = {}
    for r in rows:
        bins[r.container_no] += r.tokens
        assert kinds.setdefault(r.container_no, r.capacity_tokens) == r.capacity_tokens
        seen[r.doc_id] += r.tokens
        assert r.first_token == r.piece_no * max(caps)
    for b, used in bins.items():
        fits = [c for c in sorted(caps) if c >= used]
        assert fits and kinds[b] == fits[0]  # downsized to the least capacity that holds it
    want = Counter()
    for i, s in sizes:
        want[i] += s
    assert seen == +want
    cut = {r.doc_id for r in rows if r.piece_no}
    assert cut == {i for i, s in sizes if s > max(caps)}
    return sum(kinds.values())


@pytest.mark.parametrize("caps", [[50], [10, 25, 100], [7, 1000]])
def test_every_token_once_and_nothing_overfull(spark, caps):
    rng = random.Random(4)
    sizes = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), 25])) for i in range(400)]
    cost = check(laid(spark, sizes, caps), sizes, caps)
    assert cost < sum(s for _, s in sizes) * 1.1 + max(caps)


def test_one_size_ties_zero_and_empty(spark):
    rows = laid(spark, [(i, 10) for i in range(100)] + [(200, 0)], [30])
    assert len({r.container_no for r in rows}) == 34 and len(rows) == 100
    assert laid(spark, [], [30]) == []
    assert check(laid(spark, [(1, 31), (1, 31)], [30]), [(1, 31), (1, 31)], [30]) == 90
    with pytest.raises(ValueError):
        laid(spark, [(1, 1)], [])


def test_fit_equals_plain_best_fit():
    """On the histogram, group by group, as many bins as best fit item by item."""
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = min((r for r in rooms if r >= s), default=None)
            if fit is None:
                rooms.append(100 - s)
            else:
                rooms.remove(fit)
                rooms.append(fit - s)
        plan = packing.best_fit(Counter(sizes), [100])
        assert abs(plan.cost // 100 - len(rooms)) <= 1
        assert sum(n for _, _, n, _, _ in plan.runs) == len(sizes)


def test_mixed_capacities_beat_the_best_single_one(spark):
    """85 goes twice into 170 and 50 twice into 100, with nothing unused; either capacity alone wastes some."""
    counts = {85: 60, 50: 60}
    single = {c: packing.best_fit(counts, [c]).cost for c in (100, 170)}
    assert single == {100: 9000, 170: 8500}
    assert packing.least_cost(counts, [100, 170]).cost == 85 * 60 + 50 * 60 == 8100
    sizes = [(i, 85 if i < 60 else 50) for i in range(120)]
    rows = laid(spark, sizes, [100, 170])
    assert check(rows, sizes, [100, 170]) == 8100 and {r.capacity_tokens for r in rows} == {100, 170}


def test_bins_by_contents_place_every_item():
    rng = random.Random(6)
    for _ in range(60):
        caps = sorted(rng.sample(range(20, 200), 3))
        sizes = Counter(rng.randrange(1, caps[-1] + 1) for _ in range(rng.randrange(1, 200)))
        for plan in (packing.by_contents(sizes, caps), packing.least_cost(sizes, caps)):
            placed, bins = Counter(), Counter()
            for size, start, items, first, each in plan.runs:
                assert start == placed[size]
                placed[size] += items
                for k in range(items):
                    bins[first + k // each] += size
            assert placed == sizes
            kinds = {b + k: c for b, n, c in plan.bins for k in range(n)}
            assert set(kinds) == set(bins) and all(bins[b] <= kinds[b] for b in bins) and sum(kinds.values()) == plan.cost
            assert plan.cost <= 2 * sum(s * n for s, n in sizes.items()) + caps[-1]


def test_layouts_per_kind_and_jointly(spark):
    sizes = spark.createDataFrame([(i, 5 + i % 90) for i in range(300)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("small", 32), ("large", 128), (None, None)], "container_kind string, capacity_tokens int")
    out = packing.container_layouts(sizes, kinds)
    use = {r.layout: r for r in packing.layout_use(out).collect()}
    assert set(use) == {"small", "large", "joint"} and len({r.tokens for r in use.values()}) == 1
    assert use["joint"].capacity <= min(use["small"].capacity, use["large"].capacity)
    assert {(r.container_kind, r.capacity_tokens) for r in out.select("container_kind", "capacity_tokens").distinct().collect()} <= {("small", 32), ("large", 128)}


def test_token_counts(spark):
    texts = [(1, "Hello, world! It's 2024."), (2, ""), (3, None), (4, "a" * 50), (5, "one two three " * 40_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens.encoder(f.read())
    assert set(got) == {1, 4, 5} and got[1] == len(encode(texts[0][1])) and 0 < got[4] < 50
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("t", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})
    assert got[5] == len(whole.encode_ordinary(texts[4][1]))  # parts do not change the count
