import random

import numpy as np

from weftline.llm.minhash import Scheme, keep_one, near_duplicates

SCHEMA = "doc_id long, text string, kept string, component_id int"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, percent):
    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in docs if d is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return sorted(((d, len(s), label.get(d), label.get(d) == d if d is not None else True) for d, s in sets), key=str)


def corpus(seed=3, groups=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs, k = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((k, " ".join(w)))
            k += 1
    rng.shuffle(docs)
    return docs


def test_components_equal_brute_force(spark):
    docs = corpus() + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one two three"), (906, "ü ü ü ü ü ü"), (None, "one two"), (907, "x " * 40_000), (1, dict(corpus())[1])]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(df, Scheme(percent=85, block=16)).collect()), key=str)
    assert got == brute(docs, 85)


def test_keep_one_leaves_one_of_each_group(spark):
    docs = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, None), (5, "other words stand here as well")]
    df = spark.createDataFrame([(d, t, "x", d) for d, t in docs], SCHEMA)
    left = keep_one(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5]


def test_an_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_and_bounds():
    for percent in (80, 85):
        s = Scheme(percent=percent)
        assert (1 - s.threshold**s.rows) ** s.bands <= s.band_miss
        assert s.bands * s.rows <= s.hashes
    # the posterior bound hardly ever drops a pair at the threshold
    s, rng = Scheme(), np.random.default_rng(1)
    trials = rng.random((4000, s.hashes)) < 0.86
    lost = np.zeros(4000, bool)
    for n, least in s.least_matches:
        lost |= trials[:, :n].sum(1) < least
    assert lost.mean() < 0.002


def test_rows_of_one_id_are_linked_each_by_its_text(spark):
    rng = np.random.default_rng(8)
    a, b = (" ".join(f"w{k}" for k in rng.integers(0, 900, 60)) for _ in range(2))
    docs = [(1, a), (1, b), (2, b + " tail"), (3, "one " * 3), (3, b + " end"), (None, a), (None, a)]
    df = spark.createDataFrame([(d, t, "x", d) for d, t in docs], SCHEMA)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]
    left = sorted(((r["doc_id"], r["text"]) for r in keep_one(df).collect()), key=str)
    assert left == sorted([(1, a), (1, b), (3, "one " * 3), (None, a), (None, a)], key=str)


def test_large_neighbourhoods_are_compared_bucket_by_bucket(spark):
    docs = corpus(seed=5, groups=2, copies=70)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    scheme = Scheme(percent=85, block=2, block_shingles=200)
    assert scheme.bands < 35
    got = sorted((tuple(r) for r in near_duplicates(df, scheme).collect()), key=str)
    assert got == brute(docs, 85)
