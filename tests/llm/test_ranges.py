import random

from pyspark.sql import functions as F

from weftline.llm.ranges import SHARD, range_sharded


def dealt(spark, ids, shard_rows, parts):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, k int").repartition(parts)
    return sorted((r["k"], r[SHARD]) for r in range_sharded(df, "id", F.xxhash64("k"), shard_rows).collect())


def test_shards_follow_the_ids_and_split_crowded_ones(spark):
    rng = random.Random(3)
    clumped = [rng.randint(0, 50) for _ in range(300)] + [1 << 40] * 90 + [(1 << 62) + k for k in range(40)] + [-5, -(1 << 62)] + [None] * 70
    for shard_rows in (7, 25, 10_000):
        got = dealt(spark, clumped, shard_rows, 1)
        assert got == dealt(spark, clumped, shard_rows, 5)
        by_shard = {}
        for k, s in got:
            by_shard.setdefault(s, []).append(clumped[k])
        before = None
        for s in sorted(by_shard):
            key = [(i is not None, i or 0) for i in by_shard[s]]
            assert before is None or before <= min(key)
            before = max(key)
            # a hash deals a crowded id, so its shards are about as large as they should be
            assert len(key) <= 3 * shard_rows
        assert sum(map(len, by_shard.values())) == len(clumped)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, k int")
    assert range_sharded(df, "id", F.xxhash64("k"), 10).collect() == []
