import hashlib
import random
from collections import Counter

import pytest

from weftline.llm.runindex import RunLengthIndex, Settings, remove_repeats

SCHEMA = "doc_id long, text string, row string, seg int"
LENGTH = 40


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [piece(n) for n in (30, 45, 60, 90, 150)]
    docs = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else piece(rng.randint(1, 80)) for _ in range(rng.randint(1, 8))]
        docs.append("".join(parts))
    line = piece(55)
    docs += [piece(50) + line + piece(50) for _ in range(30)]
    return [*docs, docs[0], docs[0], "ab" * 200, "x" * 1000, None, "", "short", "x" * 39]


@pytest.mark.parametrize("block", [1, 8, 512])
def test_removal_equals_brute_force(spark, block):
    docs = [(k, t) for k, t in enumerate(corpus(block))]
    docs += [(None, docs[3][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    got = remove_repeats(df, Settings(length=LENGTH, kmer=12, block_segments=block)).collect()
    want = brute([(t or "").encode() for _, t in docs], LENGTH)
    assert sorted(map(tuple, got), key=str) == sorted(((d, *w) for (d, _), w in zip(docs, want, strict=True)), key=str)


def test_an_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        index = RunLengthIndex(texts)
        got = index.matching_statistics()
        for i, t in enumerate(texts):
            for k in range(len(t)):
                best = 0
                for j, u in enumerate(texts):
                    for m in range(len(u)):
                        if (i, k) != (j, m):
                            n = 0
                            while k + n < len(t) and m + n < len(u) and t[k + n] == u[m + n]:
                                n += 1
                            best = max(best, n)
                assert got[index.first[i] + k] == best


def test_runs_are_fewer_in_repetitive_texts():
    text = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(300))
    index = RunLengthIndex([text] * 20)
    assert len(index.heads) < len(index.text) / 5
    assert len(index.at_heads) == len(index.at_ends) == len(index.symbols)


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = piece(70)
    docs = [(1, piece(60) + shared), (1, shared + piece(90)), (1, piece(100)), (2, "x" + shared), (None, piece(80)), (None, piece(80) + shared[:50])]
    got = remove_repeats(spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA), Settings(length=LENGTH, kmer=12)).collect()
    want = brute([t.encode() for _, t in docs], LENGTH)
    assert sorted(map(tuple, got), key=str) == sorted(((d, *w) for (d, _), w in zip(docs, want, strict=True)), key=str)


@pytest.mark.parametrize("block", [2, 40])
def test_a_line_in_very_many_documents(spark, block):
    rng = random.Random(block)
    piece = lambda n: "".join(rng.choice("ab") for _ in range(n))
    line, tails = piece(45), [piece(12) for _ in range(5)]
    docs = [(k, piece(30) + rng.choice(tails) + line + rng.choice(tails) + piece(30)) for k in range(150)] + [(900, (line + "ab") * 400)]
    got = remove_repeats(spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA), Settings(length=LENGTH, kmer=12, block_segments=block, symbols=600)).collect()
    want = brute([t.encode() for _, t in docs], LENGTH)
    assert sorted(map(tuple, got)) == sorted((d, *w) for (d, _), w in zip(docs, want, strict=True))
