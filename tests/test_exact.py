"""Exact values: one pass against replacing value by value, automata in shards, scopes of what jobs write."""

import os
import random
import time

from pyspark.sql import functions as F

from tracelake import shared
from tracelake.functions.exact import Values, chosen, replaced
from tracelake.functions.rules import print_of
from tracelake.operators import redaction


def one_by_one(text, groups):
    """Values replaced in turn, earlier groups and longer values first; marks are opaque."""
    parts, n = [text], 0
    for name, values in groups.items():
        for v in sorted(set(values), key=lambda v: (-len(v), v)):
            new = []
            for p in parts:
                if isinstance(p, tuple) or v not in p:
                    new.append(p)
                    continue
                for i, x in enumerate(p.split(v)):
                    new += [(name, v)] * (i > 0) + [x]
            parts = new
    done = [(p[0], print_of(p[1])) for p in parts if isinstance(p, tuple)]
    return "".join(p if isinstance(p, str) else f"[REDACTED:{p[0]}:{print_of(p[1])}]" for p in parts), done


def test_values_as_one_by_one():
    rng = random.Random(3)
    for _ in range(800):
        alphabet = rng.choice(["ab", "abc", "aé😀"])
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        groups = {"env-value": ["".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 3))], "known-secret": ["".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(4)]}
        values = Values(groups)
        assert replaced(text, chosen(text, values.found(text)), values.names) == one_by_one(text, {"env-value": groups["env-value"], "known-secret": [v for v in groups["known-secret"] if v not in groups["env-value"]]}), (text, groups)


def test_longest_value_wins():
    by = redaction.Redactor([], {"known-secret": ["secret", "secret-token-1", "token-1-abc"]})
    assert by.text("x secret-token-1-abc secret")[0] == f"x [REDACTED:known-secret:{print_of('secret-token-1')}]-abc [REDACTED:known-secret:{print_of('secret')}]"
    assert not redaction.Redactor([], {}) and redaction.Redactor([], {"a": ["", "x"]}).text("axa")[1] == [("a", print_of("x"))]


def test_time_does_not_follow_the_number_of_values():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    text = " ".join(word() for _ in range(20_000))
    took = []
    for n in (20, 20_000):
        by = redaction.Redactor([], {"known-secret": [word() for _ in range(n)] + text.split(" ")[:50]})
        began = time.perf_counter()
        assert len(by.text(text)[1]) == 50
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]  # a thousand times the values


def test_scrub_in_shards(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(400)]
    texts = [(i, " ".join(rng.choices(words, k=40)) if i % 9 else None, "c") for i in range(60)] + [(99, "", "c"), (98, words[0] * 500, "c")]
    rows = spark.createDataFrame(texts, "id long, text string, rule string").withColumn("value", F.lit(1))
    picked = [("known-secret", w) for w in words[:150]] + [("env-value", w) for w in words[100:200]] + [("env-value", None), ("a", "")]
    values = spark.createDataFrame(picked, "rule string, value string")
    env = {w for r, w in picked if r == "env-value" and w}
    groups = {"env-value": env, "known-secret": {w for r, w in picked if r == "known-secret" and w not in env}}
    want = {i: one_by_one(t, groups) if t is not None else (None, []) for i, t, _ in texts}
    for most in (1 << 20, 300):
        got = {r.id: (r.text, [(x.rule, x.fingerprint) for x in r.redacted]) for r in redaction.scrub(rows, "text", values, most).collect()}
        assert got == want
    assert redaction.scrub(rows, "text", values.limit(0)).where("size(redacted) > 0").count() == 0
    assert redaction.scrub(rows.limit(0), "text", values).columns == ["id", "text", "rule", "value", "redacted"]


def test_large_sets_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(redaction, "LARGE", 10)
    rows = spark.createDataFrame([("a secret here",)], "text string")
    assert [r.text for r in redaction.redact(rows, "text", exact={"known-secret": ["secret"]}).collect()] == [f"a [REDACTED:known-secret:{print_of('secret')}] here"]


def test_scopes(spark, tmp_path):
    kept = shared.settle(spark.range(3), "kept")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    with shared.scope(spark):
        inner = shared.settle(spark.range(5), "inner")
        with shared.scope(spark):
            shared.settle(spark.range(7), "innermost")
            shared.share(spark, [1])
        assert inner.count() == 5
        shared.clear(spark)  # of this scope alone
        assert kept.count() == 3
    assert set(os.listdir(root)) == before and kept.count() == 3
    shared.drop(kept)
