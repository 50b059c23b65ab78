"""Scopes by revision, chains of mappings, rewrites of hot trees, replicas that differ."""

import random

from pyspark.sql import functions as F

from tracelake.operators import graph, ledger


def sha(k):
    return f"{k:040x}"


def brute(edges, start, maps):
    """{rev: set of shas}: each revision's history, then mappings to a fixpoint, one revision at a time."""
    out = {}
    for rev, tips in start.items():
        seen, todo = set(), list(tips)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += edges.get(x, [])
        while True:
            more = {s for anchor, sup, succ in maps if anchor in seen and succ in seen for s in sup} - seen
            if not more:
                break
            seen |= more
        out[rev] = seen
    return out


def test_scopes(spark, monkeypatch):
    rng = random.Random(6)
    edges = {k: sorted({rng.randrange(k) for _ in range(rng.choice([1, 1, 2]))}) for k in range(1, 60)}
    edges[70], edges[71] = [71], [70]  # a cycle, which histories have not, does no harm
    revs = {f"r{i:02d}": [rng.randrange(60)] for i in range(9)} | {"loop": [70], "gone": [99]}
    maps = [(rng.randrange(80), [rng.randrange(60, 95), rng.randrange(95)], rng.randrange(95)) for _ in range(60)]
    want = brute(edges, revs, maps)
    commits = spark.createDataFrame([(sha(k), [sha(p) for p in edges.get(k, [])]) for k in [*range(60), 70, 71]], "sha string, parents array<string>")
    revisions = spark.createDataFrame([(r, sha(t)) for r, ts in revs.items() for t in ts], "rev string, sha string")
    mappings = spark.createDataFrame([(sha(a), [sha(x) for x in s], sha(t)) for a, s, t in maps], "anchor string, superseded array<string>, successor string")
    for labels in (63, 4):
        monkeypatch.setattr(graph, "LABELS", labels)
        got = {}
        for r in graph.scopes(commits, revisions, mappings).collect():
            assert r.sha not in got.setdefault(r.rev, set())
            got[r.rev].add(r.sha)
        assert got == {r: {sha(x) for x in xs} for r, xs in want.items()}


def test_a_mapping_needs_both_sides_in_one_view(spark):
    """One revision holds the mapping, another its successor: neither sees what it supersedes, both together would."""
    commits = spark.createDataFrame([(sha(1), []), (sha(2), [])], "sha string, parents array<string>")
    mappings = spark.createDataFrame([(sha(1), [sha(3)], sha(2))], "anchor string, superseded array<string>, successor string")
    revisions = spark.createDataFrame([("a", sha(1)), ("b", sha(2)), ("both", sha(1)), ("both", sha(2))], "rev string, sha string")
    got = {(r.rev, int(r.sha, 16)) for r in graph.scopes(commits, revisions, mappings).collect()}
    assert got == {("a", 1), ("b", 2), ("both", 1), ("both", 2), ("both", 3)}


def test_chains_of_mappings_take_few_rounds(spark, monkeypatch):
    n, rounds, real = 3000, [], graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, name: (rounds.append(name), real(df, name))[1])
    name = F.lpad(F.lower(F.hex("id")), 40, "0")
    after = F.lpad(F.lower(F.hex(F.col("id") + 1)), 40, "0")
    anchor = F.when(F.col("id") % 2 == 0, name).otherwise(F.lit(sha(0)))
    maps = spark.range(n).select(anchor.alias("anchor"), F.array(after).alias("superseded"), name.alias("successor"))
    start = spark.createDataFrame([(sha(0),)], "sha string")
    assert graph.reanchor(start, maps).count() == n + 1
    assert rounds.count("new") < 20


def test_large_graphs_are_contracted(spark, monkeypatch):
    """Chains, trees, cycles and labels that some edges stop, contracted down to a few edges: as followed edge by edge."""
    rng, made, real = random.Random(3), [], graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, name: (made.append((name, *(out := real(df, name)))), out)[1])
    monkeypatch.setattr(graph, "SMALL", 5)
    monkeypatch.setattr(graph, "WALK", 2)
    ways = [(k, k + 1, -1 if k % 9 else rng.randrange(1, 8)) for k in range(80)] + [(k, k // 2, 5) for k in range(101, 160)] + [(200, 201, 7), (201, 202, 6), (202, 200, 3), (40, 40, 1), (30, 31, 2), (17, 60, 4), (80, 200, 7), (400, 401, 7)]
    ways += [(rng.randrange(300, 340), rng.randrange(300, 340), rng.randrange(8)) for _ in range(60)] + [(5, 310, 7)]
    start = {0: 3, 12: 4, 150: 1, 79: 6, 500: 1}
    want = dict(start)
    while True:
        before = dict(want)
        for a, b, m in ways:
            if want.get(a, 0) & m:
                want[b] = want.get(b, 0) | want[a] & m
        if want == before:
            break
    edges = spark.createDataFrame(ways, "src long, dst long, mask long")
    got = [tuple(r) for r in graph.reach(edges, spark.createDataFrame([*start.items()], "node long, bits long")).collect()]
    assert len(got) == len(want) and dict(got) == want
    sizes = [n for name, _, n in made if name == "links"]
    assert len(sizes) > 3 and sizes[-1] < sizes[0] / 2
    reached = {a for a, _ in graph.closure(edges.select("src", "dst"), spark.createDataFrame([(0,)], "node long")).select("node", "node").collect()}
    assert set(range(81)) | {200, 201, 202} <= reached and not reached & {400, 401, 150}


def test_mappings_in_view_ask_nothing(spark, monkeypatch):
    """Half of a chain hangs on one commit: once all is in view no edges are made from it again."""
    asked, real = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, start: (asked.append(edges.count()), real(edges, start))[1])
    name, after = (F.lpad(F.lower(F.hex(F.col("id") + i)), 40, "0") for i in (0, 1))
    maps = spark.range(200).select(F.when(F.col("id") % 2 == 0, name).otherwise(F.lit(sha(0))).alias("anchor"), F.array(after).alias("superseded"), name.alias("successor"))
    assert graph.reanchor(spark.createDataFrame([(sha(0),)], "sha string"), maps).count() == 201
    assert len(asked) == 1 and asked[0] <= 201


def test_hot_trees_make_a_row_a_branch(spark):
    """However many candidates share a tree or patch, a branch and a commit meet one row of them."""
    branches = spark.createDataFrame([("hot", "t", None), ("one", "u", "p"), ("patch", "none", "q"), ("self", None, None), ("no", "x", "y")], "branch string, tree string, patch_id string")
    many = spark.range(10_000).select(F.concat(F.lit("c"), "id").alias("sha"), F.lit("t").alias("tree"), F.lit("p").alias("patch_id"))
    candidates = many.unionByName(spark.createDataFrame([("s1", "u", None), ("s2", None, "q"), ("s2", None, "q")], "sha string, tree string, patch_id string"))
    got = {r.branch: (r.successor, r.method, r.outcome) for r in graph.detect_squash(branches, candidates).collect()}
    assert got == {"hot": (None, None, "ambiguous"), "one": ("s1", "tree", "detected"), "patch": ("s2", "patch-id", "detected"), "self": (None, None, "unmatched"), "no": (None, None, "unmatched")}
    noted = spark.createDataFrame([("c5", "p"), ("s2", "q"), ("n1", "q"), ("n2", "r"), ("n3", "z")], "sha string, patch_id string")
    more = candidates.select("sha", "patch_id").unionByName(spark.createDataFrame([("n2", "r"), ("r2", "r")], "sha string, patch_id string"))
    assert {tuple(r) for r in graph.detect_rebase(noted, more).collect()} == {("n1", "s2"), ("n2", "r2")}


def test_merges_touch_what_differs(spark):
    rows = [(f"a{i % 5}", f"id{i}", "x") for i in range(40)] + [(None, "pending", "x")]
    local = spark.createDataFrame(rows, "anchor string, id string, text string")
    remote = spark.createDataFrame([r for r in rows if r[1] not in ("id3", "pending")] + [("z", "other", "y")], local.schema).repartition(3)
    odd = {(r.anchor, r.local_lines, r.remote_lines) for r in ledger.differing(local, remote).collect()}
    assert odd == {("a3", 8, 7), (None, 1, 0), ("z", 0, 1)}
    everything = {*rows, ("z", "other", "y")}
    assert sorted(map(str, ledger.merge(local, remote).collect())) == sorted(map(str, local.union(remote).distinct().collect()))
    assert {tuple(r) for r in ledger.merge(local, remote).collect()} == everything
    scope = spark.createDataFrame([("a1",), ("a3",)], "anchor string")
    assert {tuple(r) for r in ledger.push(local, remote, scope).collect()} == everything - {(None, "pending", "x")}
    assert ledger.differing(local, local.repartition(4)).isEmpty()
