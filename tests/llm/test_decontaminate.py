import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from weftline.llm.decontaminate import Index, Settings, contaminated, lower_slices, remove_contaminated
from weftline.llm.decontaminate import PUNCTUATION
from weftline.llm.textkit import Words

rng = random.Random(11)
VOCABULARY = [f"word{k}" for k in range(300)] + ["the", "of", "and"] * 30


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = [(k, f"{sentence(14)}. {sentence(7)}.") for k in range(120)] + [(500, "Éléphant çà et là. Où vont les grands fleuves du nord?"), (501, ""), (502, None), (503, "The of and. The of and word1 word2.")]
DOCS = [(k, sentence(200), k, "x") for k in range(60)]
DOCS += [(100, f"{sentence(70)} {ITEMS[3][1]} {sentence(70)}", 0, "x"), (101, ITEMS[4][1].upper(), 0, "x"), (102, "!! ".join(ITEMS[120][1].upper().split()), 0, "x")]
DOCS += [(103, None, 0, "x"), (104, "", 0, "x"), (None, ITEMS[5][1], 0, "x"), (105, " ".join(ITEMS[6][1].split()[:9]), 0, "x"), (100, ITEMS[7][1], 0, "x"), (106, f"{'filler ' * 30_000}{ITEMS[8][1]}", 0, "x")]
DOC_SCHEMA, ITEM_SCHEMA = "doc_id long, text string, item_id int, score string", "item_id long, text string"


def test_hits_are_the_planted_ones(spark):
    docs, items = spark.createDataFrame(DOCS, DOC_SCHEMA), spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert got == {(100, 3), (101, 4), (102, 500), (None, 5), (100, 7), (106, 8)}
    blocks = contaminated(docs, items, Settings(index_bytes=4000)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == got
    left = remove_contaminated(docs, items)
    assert left.columns == docs.columns
    gone = {100, 101, 102, 106}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, *_ in DOCS if d is not None and d not in gone)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, DOC_SCHEMA), spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    assert contaminated(spark.createDataFrame([], DOC_SCHEMA), items).collect() == []
    assert contaminated(docs, spark.createDataFrame([], ITEM_SCHEMA)).collect() == []
    assert remove_contaminated(docs, spark.createDataFrame([], ITEM_SCHEMA)).count() == len(DOCS)


def test_block_max_wand_retrieves_all_above_the_threshold():
    s = Settings(share=0.2, block=4)
    index = Index([k for k, _ in ITEMS], [t for _, t in ITEMS], s)
    for _ in range(150):
        text = sentence(rng.randint(3, 60)) + " " + " ".join(rng.choice(ITEMS[:120])[1].split()[: rng.randint(0, 21)])
        _, _, raw, offsets = next(lower_slices(pa.array([text])))
        query = np.unique(Words(raw, offsets, PUNCTUATION).hash)
        scores = np.zeros(len(ITEMS))
        for t in np.flatnonzero(np.isin(index.vocabulary, query)):
            part = slice(index.first[t], index.first[t + 1])
            scores[index.item[part]] += index.impact[part]
        got = dict(index.retrieve(query))
        assert set(got) == set(np.flatnonzero(scores >= 1 - 1e-9).tolist())
        assert all(abs(scores[k] - v) < 1e-9 for k, v in got.items())


def test_passage_bounds_lose_nothing():
    index = Index([k for k, _ in ITEMS], [t for _, t in ITEMS], Settings(share=0.3))
    for _ in range(20):
        text = f"{sentence(rng.randint(0, 150))} {rng.choice(ITEMS[:120])[1]} {sentence(rng.randint(0, 150))}"
        _, _, raw, offsets = next(lower_slices(pa.array(["a b", text])))
        w = Words(raw, offsets, PUNCTUATION)
        through = set(index.passages(w))
        lo, end = int(w.bound[1]), int(w.bound[2])
        for a in range(lo, end, index.stride):
            p = (1, a, min(a + 2 * index.stride, end))
            if index.retrieve(np.unique(w.hash[p[1] : p[2]])):
                assert p in through


def test_items_with_a_null_id_count(spark):
    docs = spark.createDataFrame([(1, f"{sentence(40)} {ITEMS[9][1]} {sentence(40)}", 0, "x"), (2, ITEMS[10][1], 0, "x"), (3, sentence(90), 0, "x")], DOC_SCHEMA)
    items = spark.createDataFrame([(None, ITEMS[9][1]), (10, ITEMS[10][1]), (None, None), (None, ITEMS[11][1])], ITEM_SCHEMA)
    for s in (Settings(), Settings(index_bytes=200)):
        assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items, s).collect()} == {(1, None), (2, 10)}
        assert [r["doc_id"] for r in remove_contaminated(docs, items, s).collect()] == [3]


def words_of(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_scores_equal_bm25_by_hand(spark):
    """Whatever the number of indexes, scores are BM25 over all items."""
    s = Settings()
    items = [(k, t) for k, t in ITEMS if k < 30]
    bags = {k: words_of(t) for k, t in items}
    mean = sum(map(len, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in set(b))

    def score(item, passage):
        total = 0.0
        for w, tf in Counter(bags[item]).items():
            if w in passage:
                idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                total += idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(bags[item]) / mean))
        return total

    docs = [(k, f"{sentence(20)} {t} {sentence(20)}", 0, "x") for k, t in items]
    df_docs, df_items = spark.createDataFrame(docs, DOC_SCHEMA), spark.createDataFrame(items, ITEM_SCHEMA)
    for index_bytes in (64 << 20, 1500):
        got = {(r["doc_id"], r["item_id"]): r for r in contaminated(df_docs, df_items, Settings(index_bytes=index_bytes)).collect()}
        assert set(got) == {(k, k) for k, _ in items}
        for (d, k), r in got.items():
            assert abs(r["threshold"] - s.share * score(k, bags[k])) < 1e-9
            text = words_of(docs[d][1])
            passages = [set(text[a : a + 2 * s.window]) for a in range(0, len(text), s.window)]
            assert min(abs(r["score"] - score(k, p)) for p in passages) < 1e-9


def test_block_maxima_are_stored():
    index = Index([k for k, _ in ITEMS], [t for _, t in ITEMS], Settings(block=4))
    for t in range(len(index.vocabulary)):
        a, b, at = int(index.first[t]), int(index.first[t + 1]), int(index.block_first[t])
        want = [index.impact[k : min(k + 4, b)].max() for k in range(a, b, 4)]
        assert index.block_most[at : int(index.block_first[t + 1])].tolist() == want and index.most[t] == max(want)


def test_a_long_item_stands_in_windows(spark):
    item = f"{sentence(900)}. {sentence(300)}."
    words = item.split()
    docs = [(1, f"{sentence(150)} {item} {sentence(150)}", 0, "x"), (2, " ".join(words[:700]), 0, "x"), (3, sentence(900), 0, "x"), (4, ITEMS[2][1], 0, "x")]
    items = spark.createDataFrame([(7, item), (2, ITEMS[2][1])], ITEM_SCHEMA)
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(docs, DOC_SCHEMA), items).collect()} == {(1, 7), (4, 2)}
