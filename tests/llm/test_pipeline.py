import os
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF).persist()
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids, name
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        ids = left
    assert ids and [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_components_of_a_long_chain(spark, tmp_path):
    from weftline.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, f"file://{tmp_path}/cc").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_components_of_random_graphs(spark, tmp_path):
    from weftline.llm.components import components

    rng = random.Random(2)
    for k, (nodes, count) in enumerate([(200, 150), (80, 300), (300, 260)]):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)] + [(0, j) for j in range(1, 40)]
        label = list(range(nodes))
        for _ in range(nodes):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        used = {x for a, b in pairs if a != b for x in (a, b)}
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), f"file://{tmp_path}/g{k}").collect()}
        assert got == {x: label[x] for x in used}


def test_components_of_no_edges(spark, tmp_path):
    from weftline.llm.components import components

    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/none").collect() == []


def prose(rng, n):
    words = ["river", "stone", "under", "walk", "light", "the", "of", "green", "seven", "house", *(f"w{k}" for k in range(200))]
    w = [rng.choice(words) for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 8]) for i in range(0, n, 8))


def test_run_equals_brute_force(spark, tmp_path):
    """Every stage over a small corpus with odd rows, against what plain Python says of it."""
    import numpy as np
    from tokenizers import Tokenizer

    from tests.llm.test_minhash import shingles
    from weftline.llm.queries import tokenizer_path

    rng = random.Random(12)
    good = [(k, prose(rng, rng.randint(40, 90))) for k in range(60)]
    bad = [(100 + k, " | ".join(x.upper() + "!!" for x in prose(rng, 60).split())) for k in range(40)]
    item = prose(rng, 30)
    copies = [(200, good[0][1] + " tail"), (201, good[0][1] + " end"), (3, good[3][1]), (3, good[3][1]), (3, good[4][1] + " again")]
    planted = [(300, f"{prose(rng, 40)} {item} {prose(rng, 40)}"), (301, f"{prose(rng, 40)}. Write to jane.doe@mail.example now. {prose(rng, 30)}")]
    odd = [(400, None), (401, ""), (402, "  \n"), (None, good[5][1]), (None, prose(rng, 50)), (403, prose(rng, 20_000))]
    docs = good + bad + copies + planted + odd
    rows = [(d, t, "en", "src", None if t is None else len(t), "h", 1.0, True) for d, t in docs]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h1 string, score double, kept boolean").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + bad if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    given = table
    for name, stage in pipeline.STAGES:
        table = pipeline.save(stage(spark, table, folder), f"file://{folder}/{name}")
        seen[name] = table.collect()
        if name != "packing":
            assert table.schema == given.schema
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in seen[name]), key=str)

    # quality: bad rows go, clean ones stay (texts without a word may do either)
    left = texts("quality")
    assert not any(d is not None and 100 <= d < 200 for d, _ in left)
    clean = [r for r in docs if r not in bad and (r[1] or "").strip()]
    assert sorted((r for r in left if (r[1] or "").strip()), key=str) == sorted(clean, key=str)

    # near duplicates: of each component of rows with an id the smallest stays, once
    sets = [shingles(t) if d is not None else frozenset() for d, t in left]
    label = list(range(len(left)))
    for _ in left:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    want = []
    for c in set(label):
        members = [left[i] for i in range(len(left)) if label[i] == c]
        want.append(min(members, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert texts("near_duplicates") == sorted(want, key=str)

    # decontamination: the holder of the test item goes
    want = [r for r in want if item not in (r[1] or "")]
    assert texts("decontamination") == sorted(want, key=str) and len(want) + 1 == len(seen["near_duplicates"])

    # personal data: the address goes, all else stays
    want = [(d, t and t.replace("jane.doe@mail.example", "<EMAIL>")) for d, t in want]
    assert texts("personal_data") == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"] if r["text"])

    # packing: each token of each document once, sequences without gaps
    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    tokens = sorted((str(d), len(encode(t or "", add_special_tokens=False).ids) + 1) for d, t in want)
    whole = sorted((str(r["doc_id"]), r["doc_tokens"]) for r in seen["packing"] if r["start"] == 0)
    assert whole == tokens and sum(r["length"] for r in seen["packing"]) == sum(n for _, n in tokens)
    fill = {}
    for r in sorted(seen["packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024
    ran = pipeline.run(spark, folder).collect()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert np.sum([r["length"] for r in ran]) == np.sum([r["length"] for r in seen["packing"]])
    assert sorted(str(r["doc_id"]) for r in ran if r["start"] == 0) == sorted(d for d, _ in tokens) and set(key) <= set(ran[0].asDict())


def test_run_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
