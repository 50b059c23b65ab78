"""Token alignment against whole texts, encoded and linked one by one."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake.llm import alignment

SF = "/root/testdata/sf0.01/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(alignment.MODEL), reason="no tokenizers here")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment._read(alignment.BYTES_MODEL), alignment._read(alignment.MODEL))


def plain(aligner, text):
    """(ids of A, ids of B, groups, links) of a text, encoded whole, or None."""
    if not text:
        return None
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    tile = {}
    for side, ids, table in (("a", a, aligner.bytes_a), ("b", b, aligner.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        at, tile[side] = 0, []
        for i in ids:
            tile[side].append((at, at + len(table[i]), i))
            at += len(table[i])
    links, k = [], 0
    for x, y, i in tile["a"]:
        while tile["b"][k][1] <= x:
            k += 1
        m = k
        while m < len(b) and tile["b"][m][0] < y:
            links.append((i, tile["b"][m][2]))
            m += 1
    both = sorted({y for _, y, _ in tile["a"]} & {y for _, y, _ in tile["b"]})
    cut = lambda side: [",".join(str(i) for x, y, i in tile[side] if lo < y <= hi) for lo, hi in zip([0, *both], both)]
    return a, b, list(zip(cut("a"), cut("b"))), links


def brute(aligner, rows):
    found = [plain(aligner, t) for _, t in rows]
    count = Counter(p for x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), x in zip(rows, found):
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        said = ";".join(f"{g}|{h}" for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


AWKWARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", " \n \n", "a\n b", "a \n\n  b\tc\r\n", "▁", "a ▁ b", "x▁y", "<|endoftext|> and <s> </s> <unk> <0x0A>", "naïve café ÀÉ", "日本語のテキスト 中文", "😀😀 👩‍👩‍👧", "a b c 　 d",
    "a\x1c b\x1d\x1e c\x85 d", "\x00 \x01", "é ́x", "don't I'll 'S 123456 3.14", "http://a.b/c?d=e&f", "x" * 5000, "é" * 3000, "ab " * 3000, " " * 700, "\t" * 300 + "x", "ﬁ ſ ½", "​‍﻿", "𝔘𝔫𝔦 𒀀",
]


def test_codes_of_awkward_texts(aligner):
    rng = random.Random(5)
    pool = [*"aé日😀▁ \n\t\r\x0b\x0c  '.,1", "  ", "the", " of", "\r\n"]
    texts = AWKWARD + ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(1500)]
    held = 0
    for t in texts:
        got, want = aligner.code(t), plain(aligner, t)
        assert (got is None) == (want is None), repr(t)
        if want:
            a, b, groups, links = want
            said = ";".join(f"{g}|{h}" for g, h in groups)
            assert got[:5] == (len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest()), repr(t)
            assert dict(zip(got[5].tolist(), got[6].tolist())) == Counter(x * len(aligner.bytes_b) + y for x, y in links)
            held += 1
    assert held > 500


def test_memory_is_forgotten(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    texts = ["one two three four", "five six seven eight", "one five nine", "two two two"]
    assert [aligner.code(t)[:5] for t in texts] == [aligner.code(t)[:5] for t in texts]


def test_align(spark, aligner, monkeypatch):
    rng = random.Random(6)
    words = ["the", "cat", "Überraschung", "naïve", "antidisestablishment", "日本", "😀", "x1", "\n", "don't"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [rows[3]] * 40 + [(None, "the cat")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "at": F.lit(1), "pairs": F.lit(0.5), "n_a": F.lit(2)})
    want = Counter(brute(aligner, rows))
    assert Counter(tuple(r) for r in alignment.align(docs.repartition(3)).collect()) == want
    # the same where little fits: chunks of a few rows, hot stripes dealt to several tasks
    for name, x in (("CHUNK", 7), ("HELD", 64), ("LINKS", 50), ("SUMS", 500)):
        monkeypatch.setattr(alignment, name, x)
    assert Counter(tuple(r) for r in alignment.align(docs.repartition(3)).collect()) == want
    assert alignment.align(docs.limit(0)).count() == 0
    counts = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs).collect()}
    linked = Counter(p for _, t in rows if (x := plain(aligner, t)) for p in set(x[3]))
    assert {k: v[0] for k, v in counts.items()} == dict(linked)
    assert all(best == (n == max(m for (c, _), m in linked.items() if c == a)) for (a, _), (n, best) in counts.items())


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_codes_of_the_test_documents(aligner):
    texts = pq.read_table(SF)["text"].to_pylist()[::12]
    for t in texts:
        got, want = aligner.code(t), plain(aligner, t)
        assert (got is None) == (want is None)
        if want:
            assert got[:2] == (len(want[0]), len(want[1])) and got[3] == len(want[3])
            assert got[4] == hashlib.sha256(";".join(f"{g}|{h}" for g, h in want[2]).encode()).hexdigest()
            assert int(np.sum(got[6])) == len(want[3])
