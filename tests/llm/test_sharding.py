"""Jump consistent hashing: places, growth, slots and folders."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import sharding


def plain_jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump_is_the_published_walk():
    rng = random.Random(1)
    keys = [0, 1, 2**64 - 1, *(rng.getrandbits(64) for _ in range(500))]
    for shards in (1, 2, 8, 9, 1000):
        got = sharding.jump(np.array(keys, dtype=np.uint64), shards).tolist()
        assert got == [plain_jump(k, shards) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = sharding.mix(np.arange(200_000, dtype=np.uint64))
    for n in (1, 8, 63):
        old, new = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = old != new
        assert (new[moved] == n).all()
        assert abs(moved.mean() - 1 / (n + 1)) < 0.004
        assert np.abs(np.bincount(new) / len(keys) - 1 / (n + 1)).max() < 0.004


def test_sharded(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "a b", "é" * 9, "x" * 5000]), "clash") for i in range(300)]
    rows += [(None, f"t{i}", "c") for i in range(400)] + [(7, "same", "c")] * 300 + [(-5, "z", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumns({"slot": F.lit(1), "size": F.lit(2.0), "_part": F.lit("p")})
    for given in (docs.repartition(5), docs.coalesce(1)):
        got = [tuple(r) for r in sharding.sharded(given).collect()]
        assert Counter(r[:3] for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        key = lambda i: int(sharding.mix(np.array([-1 if i is None else i], dtype=np.int64).view(np.uint64))[0])
        assert all(r[3] == "key" and r[4] == plain_jump(key(r[0]), 8) and r[6] == plain_jump(key(r[0]), 9) for r in got)
        for s in range(8):
            mine = sorted((r for r in got if r[4] == s), key=lambda r: r[5])
            assert [r[5] for r in mine] == list(range(len(mine)))
            order = [(r[0] is not None, r[0] or 0, r[1], r[2]) for r in mine]
            assert order == sorted(order)
    assert sharding.sharded(docs.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert sharding.sharded(named, 3).agg(F.max("grown_shard")).first()[0] == 3


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", 0.5) for i in range(500)] + [(None, None, None)] * 50, "doc_id long, text string, shard double")
    path = f"file://{tmp_path}/shards"
    want = Counter(tuple(r) for r in docs.select("doc_id", "text").collect())
    sharding.write_shards(docs, path, 4, pieces=3)
    first = {r.doc_id: r.shard for r in sharding.read_shards(spark, path, 4).collect()}
    for _ in range(2):  # again does no harm
        sharding.append_shard(spark, path, 4)
        for n in (4, 5):
            assert Counter(tuple(r) for r in sharding.read_shards(spark, path, n).select("doc_id", "text").collect()) == want
    grown = {r.doc_id: r.shard for r in sharding.read_shards(spark, path, 5).collect()}
    assert {grown[i] for i in grown if grown[i] != first[i]} == {4}
    assert 50 < sum(grown[i] != first[i] for i in grown) < 160
