import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from weftline.llm.common import work_dir  # noqa: E402
from weftline.llm.packing import Packing, pack, pack_documents  # noqa: E402
from weftline.llm.tokenfile import read_manifest, read_token_index, write_token_files  # noqa: E402
from weftline.llm.tokenize import Encoder  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = [(3, "The cat's  mat.\n", 1), (1, None, 2), (2, "", 3), (3, "again 42", 4), (None, "no id", 5), (7, "wörd Été " * 900, 6), (3, "again 42", 7)]
SCHEMA = "doc_id long, text string, start int"


def ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoding_is_exact(path):
    rng, e = random.Random(5), Encoder(path)
    letters = "ab1DSéÉ,;.!stmdrevl \n\t\r\x0b\x1c\x85\xa0 　'ß́#<|endoftext|>ΣÄ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [" a <|endoftext|>  b", "  <|endoftext|>", "I'll they've", "x" * 300]
    for text, got in zip(texts, e.encode_many(texts), strict=True):
        assert got.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_round_trip(spark):
    out = work_dir(spark, "t")
    write_token_files(spark.createDataFrame(DOCS, SCHEMA), out, WORD, end_id=1)
    rows = read_token_index(spark, out).orderBy("start").collect()
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc, text, _) in zip(rows, order, strict=True):
        want = ids(WORD, text) + [1]
        assert tuple(row) == (doc, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert read_manifest(out)["n_tokens"] == start


def test_token_files_of_an_empty_table(spark):
    out = work_dir(spark, "t")
    write_token_files(spark.createDataFrame([], SCHEMA), out, WORD, end_id=1)
    assert read_token_index(spark, out).collect() == []


def test_packing_keeps_every_token_once(spark):
    rows = pack_documents(spark.createDataFrame(DOCS, SCHEMA).coalesce(1), BYTE, Packing(capacity=64), with_ids=True).collect()
    whole = sorted((d, tuple(ids(BYTE, t) + [0])) for d, t, _ in [(d if d is not None else -1, t, x) for d, t, x in DOCS])
    used = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(len(t) for _, t in whole)
    assert sum(r["length"] for r in rows) == total and len(used) == -(-total // 64)
    one = sorted((r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4"))) for r in rows if r["doc_id"] == 7)
    assert sum((p for _, p in one), ()) == dict(whole)[7]


def test_pack_takes_descending_costs():
    p = Packing(capacity=100)
    pieces = pack(np.array([60, 250, 30, 10, 50]), p)
    fill = {}
    for _, _, n, k, offset in pieces:
        assert offset == fill.get(k, 0)
        fill[k] = offset + n
    assert sum(fill.values()) == 400 and len(fill) == 4
    assert pack_documents.__doc__


def test_packing_of_an_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), BYTE).collect() == []


def test_pack_takes_the_cheapest_sequence_with_room():
    rng = random.Random(7)
    for _ in range(40):
        p = Packing(capacity=rng.choice([16, 100]), quadratic=rng.choice([0.0, 0.1]))
        lengths = [rng.randint(1, 2 * p.capacity + 3) for _ in range(rng.randint(1, 60))]
        # the same rule over a plain list of all sequences
        want, n = [], 0
        for d, size in enumerate(lengths):
            for k in range(size // p.capacity):
                want.append((d, k * p.capacity, p.capacity, n, 0))
                n += 1
        rest = sorted(((-p.cost(x % p.capacity), d) for d, x in enumerate(lengths) if x % p.capacity))
        total = sum(lengths[d] % p.capacity for _, d in rest)
        state = {n + k: [0.0, 0] for k in range(-(-total // p.capacity))}
        costs = []
        for _, d in rest:
            size, start = lengths[d] % p.capacity, lengths[d] // p.capacity * p.capacity
            while size:
                fits = [k for k, (_, used) in state.items() if p.capacity - used >= size] or [k for k, (_, used) in state.items() if used < p.capacity]
                least = min(state[k][0] for k in fits)
                costs.append((d, start, least))
                # ties go to the one with the least room, then to the first
                k = min((k for k in fits if state[k][0] == least), key=lambda k: (p.capacity - state[k][1], k))
                take = min(size, p.capacity - state[k][1])
                want.append((d, start, take, k, state[k][1]))
                state[k] = [state[k][0] + p.cost(take), state[k][1] + take]
                start, size = start + take, size - take
        assert pack(np.array(lengths), p) == want


def test_a_very_long_text(spark):
    text = "Wörter and more, 42 times.\n" * 30_000
    out = work_dir(spark, "t")
    write_token_files(spark.createDataFrame([(1, text, 0), (2, "short", 0)], SCHEMA), out, WORD, end_id=1)
    one, two = sorted(tuple(r) for r in read_token_index(spark, out).collect())
    want = np.array([*ids(WORD, text), 1], "<u4")
    assert one == (1, 0, len(want), zlib.crc32(want.tobytes())) and two[1] == len(want)
    rows = pack_documents(spark.createDataFrame([(1, text, 0)], SCHEMA), BYTE, with_ids=True).collect()
    got = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["start"]))
    assert got == np.array([*ids(BYTE, text), 0], "<u4").tobytes() and max(r["length"] for r in rows) == 1024


def test_an_id_that_fills_several_shards(spark):
    docs = [(5, f"text {k}", 0) for k in range(60)] + [(None, "none", 0)] * 9 + [(9, "last", 0)]
    runs = []
    for parts in (1, 4):
        out = work_dir(spark, "t")
        manifest = write_token_files(spark.createDataFrame(docs, SCHEMA).repartition(parts), out, WORD, end_id=1, shard_docs=8)
        assert len(manifest["shards"]) > 5
        runs.append((manifest, sorted(tuple(r) for r in read_token_index(spark, out).orderBy("start").collect() if r[0] is not None)))
    assert runs[0] == runs[1]
    assert [d for d, *_ in sorted(runs[0][1], key=lambda r: r[1])] == [5] * 60 + [9]
