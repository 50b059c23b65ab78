"""The audit of five filters against a loop over rows and orders."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracelake.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        judged.append((s or "", {x for x, f in fails.items() if f}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {x[0] for x in judged}:
        mine = [x for x in judged if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fail = sum(f in x[1] for x in mine)
                out[part, "".join(order), k + 1] = (len(left), len(gone), fail - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, labels).collect()}


def test_audit(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["ABC", "a$", "é\x1cü", "x|y"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 49, 50, 60, 200]))) for _ in range(40)]
    texts += [None, "", " \t\n", " ".join(f"u{i}" for i in range(50)), " ".join(["A" * 5] + ["b" * 94]), "word " * 3000]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for i in range(300)]
    rows += [(None, rng.choice(texts), "s1") for _ in range(40)] + [rows[5]] * 3 + [(9, texts[1], "s2"), (9, texts[2], "s1")] + [(1000 + i, texts[0], "hot") for i in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1500, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"mask": F.lit(1), "n": F.lit("x"), "good": F.lit(2.0), "pad": F.lit(0)}).repartition(4)
    given = spark.createDataFrame(labels, LABELS).withColumn("source", F.lit("clash"))
    got, want = found(docs, given), brute(rows, labels)
    assert got == want and len(got) == 600 * 4
    assert sum(v[1] for k, v in got.items() if k[1] == "ABCDE") + sum(v[0] for k, v in got.items() if k[1] == "ABCDE" and k[2] == 5) == len(rows)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert found(docs, labels) == {}
    one = spark.createDataFrame([(None, None, None)], DOCS)
    assert found(one, labels) == brute([(None, None, None)], [])
