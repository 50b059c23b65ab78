"""Commit graphs: reachability, re-anchor mappings to a fixpoint, rewritten branches and their evidence.

Loops run on the driver over tables of ids alone; each round is written to the shared
folder, so that a lost executor costs no round before, and the loop ends when a round
adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.sieves import sieve
from tracelake.shared import counted, drop, settle


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    return settle(df, "cut")


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) reachable from start (node) along edges (src, dst), start included.

    The edges are written out once.  A round follows them, and shortcuts, from the nodes
    found in the round before.  Shortcuts are made by pointer doubling: every node's
    first edge (by nth, where edges have that column) taken 2, 4, 8 ... times, a table of
    a row a node for each; a new one starts from all nodes found.  A chain thus takes
    rounds by the logarithm of its length.  Cycles do no harm.  More than SMALL edges are
    contracted first (see _reach_large).
    """
    nth = F.col("nth") if "nth" in edges.columns else F.lit(0)
    edges, n = counted(edges.select("src", "dst", nth.cast("int").alias("nth")).where("src is not null and dst is not null"), "edges")
    if n > SMALL:
        one = F.lit(1).cast("long")
        return _reach_large(edges.select("src", "dst", one.alias("mask")), settle(start.select("node", one.alias("bits")).where("node is not null").distinct(), "seen")).select("node")
    jump = edges.groupBy("src").agg(F.min(F.struct("nth", "dst"))["dst"].alias("dst"))
    ways, found, longest = [edges.select("src", "dst")], [settle(start.select("node").distinct(), "found")], None
    along = lambda way, nodes: way.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    while True:
        ahead = along(_together(ways), found[-1])
        if longest is not None:
            ahead = ahead.unionByName(along(longest, _together(found)))
        new, n = counted(ahead.distinct().join(_together(found), "node", "left_anti"), "found")
        if not n:
            break
        found.append(new)
        longest = None
        if jump is not None and len(ways) <= 40:
            jump, n = counted(jump.alias("a").join(jump.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"), "jump")
            jump = longest = jump if n else None
            ways += [jump] if n else []
        if len(found) > 24:  # a long run of short rounds: one table again, apart from the newest
            found = [settle(_together(found[:-1]), "found"), found[-1]]
    for way in ways[1:]:
        drop(way)
    return _together(found)


#: Labels that one pass carries, a bit each.
LABELS = 63
#: Edges up to which shortcuts are made of them; more are contracted first.
SMALL = 100_000
#: Steps along the edges alone before a large graph is contracted.
WALK = 32
#: Rows up to which a step's nodes are sent to all edges; of more a sieve is sent.
SENT = 100_000


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, bits): which labels, a bit each, reach a node from start (node, bits) along edges (src, dst, mask), start included.

    An edge passes on the bits of its mask.  Up to SMALL edges get shortcuts, more are
    contracted first.
    """
    nth = F.col("nth") if "nth" in edges.columns else F.lit(0)
    edges, n = counted(edges.where("src is not null and dst is not null and mask <> 0").select("src", "dst", "mask", nth.cast("int").alias("nth")), "edges")
    seen = settle(start.groupBy("node").agg(F.bit_or("bits").alias("bits")), "seen")
    return _reach_large(edges.drop("nth"), seen) if n > SMALL else _reach_small(edges, seen)


def _reach_small(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """reach() of settled edges (src, dst, mask, nth) from settled nodes (node, bits), by shortcuts.

    A round follows, from the nodes that got new
    bits in the round before, their edges and all their shortcuts: every node's first edge
    taken 2, 4, 8 ... times, with the bits that all of them pass.  The shortcuts of a node are
    one row, to which a round adds the next; that one starts from all nodes seen.  So a chain
    takes rounds by the logarithm of its length, and cycles do no harm.
    """
    edges = edges.select("src", F.struct("nth", "dst", "mask").alias("way"))
    # a node's edges, and its newest shortcut (the first edge, to begin with)
    ways = settle(edges.groupBy("src").agg(F.array_sort(F.collect_set("way")).alias("ways")).withColumn("jump", F.col("ways")[0]), "ways")
    new, growing = seen, True
    step = lambda of, nodes: nodes.join(of, nodes["node"] == of["src"]).select(F.col("way.dst").alias("node"), F.col("bits").bitwiseAND(F.col("way.mask")).alias("bits"))
    while True:
        ahead = step(ways.select("src", F.explode("ways").alias("way")), new)
        if growing:
            ahead = ahead.unionByName(step(ways.where("jump is not null").select("src", F.col("jump").alias("way")), seen))
        got = ahead.groupBy("node").agg(F.bit_or("bits").alias("bits"))
        old = seen.select(F.col("node").alias("_n"), F.col("bits").alias("_b"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("long"))))
        new, n = counted(got.join(old, F.col("node") == F.col("_n"), "left").select("node", fresh.alias("bits")).where("bits <> 0"), "new")
        if not n:
            drop(ways)
            return seen
        before, seen = seen, settle(seen.unionByName(new).groupBy("node").agg(F.bit_or("bits").alias("bits")), "seen")
        drop(before)
        if growing:
            there = ways.where("jump is not null").select(F.col("src").alias("_s"), F.col("jump").alias("_j"))
            mask = F.col("jump.mask").bitwiseAND(F.col("_j.mask"))
            jump = F.when(mask != 0, F.struct(F.lit(0).alias("nth"), F.col("_j.dst").alias("dst"), mask.alias("mask")))
            longer = ways.join(there, F.col("jump.dst") == F.col("_s"), "left").select("src", F.when(jump.isNotNull(), F.array_union("ways", F.array(jump))).otherwise(F.col("ways")).alias("ways"), jump.alias("jump"))
            before, (ways, _) = ways, counted(longer, "ways")
            drop(before)
            growing = not ways.where("jump is not null").isEmpty()


def _or(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bit_or("bits").alias("bits"))


def _meet(rows: DataFrame, of: DataFrame, n: int, key: str) -> DataFrame:
    """Rows joined by a key with the n rows of a small settled table; what has no match there is not shuffled."""
    if n <= SENT:
        return rows.join(F.broadcast(of), key)
    return rows.where(sieve(of.select(key), n)(key)).join(of, key)


def _without(rows: DataFrame, of: DataFrame, n: int, key: str) -> DataFrame:
    """Rows whose key is none of a settled table's n; only those that may be are shuffled."""
    if n <= SENT:
        return rows.join(F.broadcast(of), key, "left_anti").select(rows.columns)
    rows = rows.withColumn("_may", sieve(of.select(key), n)(key))
    return rows.where("not _may").unionByName(rows.where("_may").join(of, key, "left_anti").select(rows.columns)).drop("_may")


def _walk(edges: DataFrame, seen: DataFrame) -> tuple[DataFrame, bool]:
    """What WALK steps along edges add to nodes seen, and whether no step adds more."""
    found, new, n = [seen], seen, seen.count()
    for _ in range(WALK):
        of = new.select(F.col("node").alias("src"), "bits")
        ahead = _meet(edges, of, n, "src").select(F.col("dst").alias("node"), F.col("bits").bitwiseAND(F.col("mask")).alias("bits"))
        old = _or(_together(found), "node").select("node", F.col("bits").alias("_b"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("long"))))
        new, n = counted(_or(ahead.where("bits <> 0"), "node").join(old, "node", "left").select("node", fresh.alias("bits")).where("bits <> 0"), "new")
        if not n:
            break
        found.append(new)
        if len(found) > 8:
            found = [settle(_or(_together(found), "node"), "seen")]
    return (settle(_or(_together(found), "node"), "seen") if len(found) > 1 else found[0]), not n


def _reach_large(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """reach() of settled edges (src, dst, mask) from settled nodes (node, bits), in time by the number of edges.

    Some steps are walked, which ends most histories.  Of what is left nodes are numbered, and
    edges contracted: a node that one other alone leads to gives its edges to that one, where a
    coin says so (of two in a row never both), and sources that nothing has reached go.  Each
    round takes a quarter of a chain, so all of them together take the time of a few.  What is
    left after all is small, or has no such nodes, and goes by shortcuts; then the contracted
    nodes get the bits of those they went to, last ones first.
    """
    seen, done = _walk(edges, seen)
    if done:
        return seen
    none = F.lit(0).cast("long")
    open_ = edges.join(seen.select(F.col("node").alias("dst"), "bits"), "dst", "left").where((F.col("src") != F.col("dst")) & (F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("bits", none))) != 0)).select("src", "dst", "mask")
    open_ = settle(open_, "edges")
    names = settle(open_.select(F.col("src").alias("node")).unionByName(open_.select(F.col("dst").alias("node"))).distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    numbered = open_.join(names.select(F.col("node").alias("src"), F.col("k").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("k").alias("b")), "dst").select("a", "b", "mask")
    links, n = counted(numbered, "links")
    drop(open_)
    bits = settle(seen.join(names, "node").select("k", "bits"), "bits")
    layers, stored, turn, slow, peel = [], links, 0, 0, True
    while n > SMALL and slow < 3:
        turn += 1
        coin = lambda c, turn=turn: F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1))
        led = links.groupBy("b").agg(F.min("a").alias("u"), F.max("a").alias("_most"), F.bit_or("mask").alias("_mask"))
        led = led.where((F.col("u") == F.col("_most")) & (coin("b") == 1) & (coin("u") == 0)).select(F.col("b").alias("k"), "u", "_mask")
        gone = settle(led.join(bits, "k", "left").select("k", "u", "_mask", F.col("bits").alias("_bits")), "gone")
        rest = links.join(gone.select(F.col("k").alias("b")), "b", "left_anti")
        if peel:
            rest = rest.join(links.select(F.col("b").alias("a")).unionByName(bits.select(F.col("k").alias("a"))), "a", "left_semi")
        moved = rest.join(gone.withColumnRenamed("k", "a"), "a", "left")
        to = F.coalesce("u", "a")
        passed = F.when(to == F.col("b"), none).otherwise(F.col("mask").bitwiseAND(F.coalesce("_mask", F.lit(-1).cast("long"))))
        moved = moved.select(to.alias("a"), "b", passed.alias("mask"), F.col("mask").bitwiseAND(F.coalesce("_bits", none)).alias("pushed")).where("mask <> 0 or pushed <> 0")
        before, (stored, m) = stored, counted(moved, "links")
        pushed = stored.where("pushed <> 0").select(F.col("b").alias("k"), F.col("pushed").alias("bits"))
        held, bits = bits, settle(_or(bits.join(gone.select("k"), "k", "left_anti").unionByName(pushed), "k"), "bits")
        drop(before)
        drop(held)
        links, slow = stored.where("mask <> 0").select("a", "b", "mask"), slow + 1 if m > 0.95 * n else 0
        peel = turn % 4 == 0 or peel and m < 0.65 * n
        layers.append(gone)
        n = m
    small = links.groupBy("a", "b").agg(F.bit_or("mask").alias("mask")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "mask", F.lit(0).alias("nth"))
    known = [_reach_small(settle(small, "edges"), settle(bits.select(F.col("k").alias("node"), "bits"), "seen")).select(F.col("node").alias("u"), "bits")]
    for gone in reversed(layers):
        own = F.coalesce("_bits", none).bitwiseOR(F.coalesce("bits", none).bitwiseAND(F.col("_mask")))
        known.append(settle(gone.join(_together(known), "u", "left").select(F.col("k").alias("u"), own.alias("bits")).where("bits <> 0"), "known"))
    named = _together(known).withColumnRenamed("u", "k").join(names, "k").select("node", "bits")
    return settle(_or(seen.unionByName(named), "node"), "seen")


def parent_edges(commits: DataFrame, first_only: bool = False) -> DataFrame:
    """(src, dst) from commits (sha, parents)."""
    if first_only:
        return commits.where(F.size("parents") > 0).select(F.col("sha").alias("src"), F.get("parents", F.lit(0)).alias("dst"))
    return commits.select(F.col("sha").alias("src"), F.posexplode("parents").alias("nth", "dst"))


def ancestors(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(sha) of all ancestors of tips (sha), tips included."""
    return closure(parent_edges(commits), tips.select(F.col("sha").alias("node"))).select(F.col("node").alias("sha"))


def sound_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings (anchor, superseded, successor) whose commits are all named by 40 hexadecimal digits."""
    sha = "^[0-9a-f]{40}$"
    return mappings.where(F.col("successor").rlike(sha) & (F.size("superseded") > 0) & F.forall("superseded", lambda x: x.rlike(sha)))


def reanchor(reachable: DataFrame, mappings: DataFrame) -> DataFrame:
    """(sha) in view once mappings are followed to a fixpoint.

    A mapping counts when the commit that holds it and its successor are both in
    view; it brings the superseded commits it lists, not their ancestors.
    """
    return reanchored(reachable.select(F.col("sha").alias("node"), F.lit(1).cast("long").alias("bits")), mappings).select(F.col("node").alias("sha"))


def reanchored(seen: DataFrame, mappings: DataFrame) -> DataFrame:
    """(node, bits) once mappings are followed to a fixpoint, for each label by itself, from (node, bits).

    A mapping has two premises, its holder and its successor.  For the labels that one of them
    has, it is an edge from the other, and where both are one commit it always is; so runs of
    mappings are followed by reach(), in rounds by the logarithm of their length.  What is left
    are mappings of which neither premise was in view: each time round the edges are made anew
    from what came into view, until nothing does.
    """
    rows = sound_mappings(mappings).select("anchor", "successor", F.explode("superseded").alias("sha"))
    seen = settle(_or(seen, "node"), "view")
    size = None
    while True:
        # what every label has brings nothing more
        every = seen.agg(F.bit_or("bits")).first()[0] or 0
        full = seen.where(F.col("bits") == every).select(F.col("node").alias("sha"))
        before, (rows, n) = rows, counted(_without(rows, full, full.count(), "sha"), "mappings")
        drop(before)
        if not n:
            return seen
        two, held = rows.where("anchor <> successor"), seen.count()
        ways = [rows.where("anchor = successor").select(F.col("successor").alias("src"), F.col("sha").alias("dst"), F.lit(-1).cast("long").alias("mask"))]
        for known, other in (("anchor", "successor"), ("successor", "anchor")):
            of = _meet(two, seen.select(F.col("node").alias(known), F.col("bits").alias("mask")), held, known)
            ways.append(of.select(F.col(other).alias("src"), F.col("sha").alias("dst"), "mask"))
        seen = reach(_together(ways), seen)
        before, size = size, seen.agg(F.count("*").alias("n"), F.sum(F.bit_count("bits")).alias("b")).first()
        if size == before or two.isEmpty():
            return seen


def scopes(commits: DataFrame, revisions: DataFrame, mappings: DataFrame) -> DataFrame:
    """(rev, sha): what is in view of each revision (rev, sha), its ancestors and what mappings bring, each for itself.

    A mapping that one revision holds and whose successor another has in view brings neither
    anything.  LABELS revisions are followed at a time, a bit each.
    """
    named = [r.rev for r in revisions.select("rev").distinct().orderBy("rev").collect()]  # what a push or a reader names
    out = []
    for i in range(0, len(named), LABELS):
        number = revisions.sparkSession.createDataFrame([(r, 1 << j) for j, r in enumerate(named[i : i + LABELS])], "rev string, bits long")
        start = revisions.join(F.broadcast(number), "rev").select(F.col("sha").alias("node"), "bits")
        history = parent_edges(commits).withColumn("mask", F.lit(-1).cast("long"))
        seen = reanchored(reach(history, start), mappings)
        out.append(seen.join(F.broadcast(number.withColumnRenamed("bits", "bit")), F.col("bits").bitwiseAND(F.col("bit")) != 0).select("rev", F.col("node").alias("sha")))
    return _together(out) if out else revisions.select("rev", "sha")


def branch_commits(commits: DataFrame, base: DataFrame, tip: DataFrame) -> DataFrame:
    """(sha) of the first-parent commits from tip (sha) that base (sha) does not reach."""
    line = closure(parent_edges(commits, first_only=True), tip.select(F.col("sha").alias("node"))).select(F.col("node").alias("sha"))
    return line.join(ancestors(commits, base), "sha", "left_anti")


def noted(commits: DataFrame, events: DataFrame) -> DataFrame:
    """The commits (sha) that hold events (anchor)."""
    return commits.join(events.select(F.col("anchor").alias("sha")), "sha", "left_semi")


def noted_counts(branches: DataFrame, events: DataFrame) -> DataFrame:
    """(branch, noted, total): how many of each branch's commits (branch, sha) hold events."""
    held = events.where(F.col("anchor").isNotNull()).select(F.col("anchor").alias("sha"), F.lit(1).alias("held")).distinct()
    return branches.distinct().join(held, "sha", "left").groupBy("branch").agg(F.count("held").alias("noted"), F.count("*").alias("total"))


def detect_squash(branches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(branch, successor, method, outcome) by the branch's tree, else its patch: detected, ambiguous or unmatched.

    branches has (branch, tree, patch_id), candidates (sha, tree, patch_id).  The two
    ways are joins of their own, and a match by tree hides those by patch.
    """
    # candidates of a key first become one row, so that a common tree or patch makes no pairs
    ways = []
    for rank, (method, key) in enumerate((("tree", "tree"), ("patch-id", "patch_id"))):
        c = candidates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("sha").alias("least"), F.max("sha").alias("most"))
        ways.append(branches.join(c, F.col(key) == F.col("_k")).select("branch", "least", "most", F.lit(method).alias("method"), F.lit(rank).alias("rank")))
    found = ways[0].unionByName(ways[1])
    best = found.groupBy("branch").agg(F.min(F.struct("rank", "method")).alias("by"), *[f(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c, f in (("least", F.min), ("most", F.max))])
    of = lambda c: F.when(F.col("by.rank") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    per = best.select("branch", F.when(of("least") == of("most"), 1).otherwise(2).alias("n"), of("least").alias("successor"), F.col("by.method").alias("method"))
    out = branches.select("branch").join(per, "branch", "left")
    outcome = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "detected").otherwise("ambiguous")
    one = F.col("n") == 1
    return out.select("branch", F.when(one, F.col("successor")).alias("successor"), F.when(one, F.col("method")).alias("method"), outcome.alias("outcome"))


def detect_rebase(noted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sha, successor): noted commits (sha, patch_id) that one other candidate's patch alone equals."""
    # of a patch's candidates the two smallest tell whether there is just one besides the commit itself
    c = candidates.where(F.col("patch_id").isNotNull()).select("patch_id", "sha").distinct()
    ends = c.groupBy("patch_id").agg(F.count("*").alias("n"), F.min("sha").alias("least"), F.max("sha").alias("most"))
    met = noted.select("sha", "patch_id").distinct().join(ends, "patch_id")
    one = F.when(F.col("n") == 1, F.when(F.col("least") != F.col("sha"), F.col("least"))).when((F.col("n") == 2) & (F.col("least") == F.col("sha")), F.col("most")).when((F.col("n") == 2) & (F.col("most") == F.col("sha")), F.col("least"))
    # a commit of several patches counts the candidates of all
    many = F.when(one.isNull() & ((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("least") != F.col("sha")) & (F.col("most") != F.col("sha")))), True)
    per = met.select("sha", one.alias("one"), many.alias("many")).groupBy("sha").agg(F.min("one").alias("successor"), F.max("one").alias("last"), F.count("many").alias("many"))
    return per.where((F.col("many") == 0) & (F.col("successor") == F.col("last"))).select("sha", "successor")


def file_overlap(left: DataFrame, right: DataFrame, top: int = 3) -> DataFrame:
    """(branch, sha, identical, score, rank): candidates by files changed alike over files changed in either.

    left has (branch, path, patch_id), right (sha, path, patch_id), a row a file.
    Pairs come from equal files alone, so a path that most commits change makes none by
    itself; then each pair's paths meet.  A branch keeps its best ones.
    """
    left, right = left.distinct(), right.distinct()
    mine = left.groupBy("branch").agg(F.count_distinct("path").alias("a"))
    theirs = right.groupBy("sha").agg(F.count_distinct("path").alias("b"))
    pairs = cut(left.join(right, ["path", "patch_id"]).groupBy("branch", "sha").agg(F.count_distinct("path").alias("identical")))
    both = pairs.join(left.select("branch", "path").distinct(), "branch").join(right.select("sha", "path").distinct(), ["sha", "path"]).groupBy("branch", "sha").agg(F.count("*").alias("both"))
    scored = pairs.join(both, ["branch", "sha"]).join(mine, "branch").join(theirs, "sha")
    scored = scored.withColumn("score", F.col("identical") / (F.col("a") + F.col("b") - F.col("both")))
    rank = F.row_number().over(Window.partitionBy("branch").orderBy(F.col("score").desc(), "sha"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("branch", "sha", "identical", "score", "rank")


def subject_hits(branches: DataFrame, candidates: DataFrame, gram: int = 8) -> DataFrame:
    """(branch, sha, hits, total): how many of a branch's subjects a candidate's message holds, anywhere in it.

    branches has (branch, subject), candidates (sha, body).  A subject meets only the
    messages that hold its rarest run of so many characters (all of it, if it is
    shorter), and is looked for there.  Empty subjects count for the total alone.
    """
    subjects = branches.select("subject").where(F.length("subject") > 0).distinct().withColumn("k", F.least(F.length("subject"), F.lit(gram)))
    subjects = cut(subjects)
    runs = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(F.col(c), i, F.lit(k) if isinstance(k, int) else k))
    asked = cut(subjects.select("subject", F.explode(F.array_distinct(runs("subject", F.col("k")))).alias("key")))
    sizes = [r.k for r in subjects.select("k").distinct().collect()]  # gram numbers at most
    bodies = cut(candidates.select("sha", "body").where(F.length("body") > 0).distinct())
    every = [F.when(F.length("body") >= k, runs("body", k)).otherwise(F.array().cast("array<string>")) for k in sizes] or [F.array().cast("array<string>")]
    held = bodies.select("sha", F.explode(F.array_distinct(F.concat(*every))).alias("key"))
    held = cut(held.join(asked.select("key").distinct(), "key", "left_semi"))
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    best = asked.join(often, "key", "left").groupBy("subject").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
    best = cut(best.where("best.n > 0").select("subject", "best.key"))
    near = best.join(held, "key").join(bodies, "sha")
    found = near.where(F.col("body").contains(F.col("subject"))).select("subject", "sha").distinct()
    total = branches.groupBy("branch").agg(F.count_distinct("subject").alias("total"))
    return branches.distinct().join(found, "subject").groupBy("branch", "sha").agg(F.count("*").alias("hits")).join(total, "branch")


def closest(shared: DataFrame, order: str = "shared", most: int = 20) -> tuple[DataFrame, str | None]:
    """The candidates of each branch that share the most files (branch, sha, shared), and a note if some were left out."""
    rank = F.row_number().over(Window.partitionBy("branch").orderBy(F.col(order).desc(), "sha"))
    ranked = shared.withColumn("_n", rank)
    over = ranked.agg(F.max("_n")).first()[0] or 0
    note = f"files were compared for the {most} closest candidates of a branch; one branch has {over}" if over > most else None
    return ranked.where(F.col("_n") <= most).drop("_n"), note


def pull_request(subject: str = "subject"):
    """The pull request number that a subject ends with, as (#N)."""
    n = F.regexp_extract(subject, r"\(#(\d+)\)\s*$", 1)
    return F.when(n != "", n.cast("int"))


def merge_bases(commits: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(sha) of the best common ancestors of two sets of tips: those that no other common ancestor descends from."""
    common = cut(ancestors(commits, left).join(ancestors(commits, right), "sha", "left_semi"))
    below = parent_edges(commits).join(common.select(F.col("sha").alias("src")), "src", "left_semi").select(F.col("dst").alias("sha"))
    return common.join(below, "sha", "left_anti")


def is_ancestor(commits: DataFrame, old: DataFrame, new: DataFrame) -> bool:
    """Whether every commit of old (sha) is reached from new (sha)."""
    return old.join(ancestors(commits, new), "sha", "left_anti").isEmpty()


def suggest(evidence: DataFrame, top: int = 3) -> DataFrame:
    """(branch, sha, tier, score, rank): the best successors of each branch by evidence (branch, sha, tier, score, place).

    Lower tiers are stronger (a pull request, listed subjects, equal files); within a
    tier the higher score counts, then the candidate's place.  Of several kinds of
    evidence for a pair the strongest stays.
    """
    pair = Window.partitionBy("branch", "sha").orderBy("tier", F.col("score").desc(), "place")
    one = evidence.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")
    rank = F.row_number().over(Window.partitionBy("branch").orderBy("tier", F.col("score").desc(), "place", "sha"))
    return one.withColumn("rank", rank).where(F.col("rank") <= top).select("branch", "sha", "tier", "score", "rank")


def newest(candidates: DataFrame, at: str = "committed_at", most: int = 200) -> tuple[DataFrame, bool]:
    """The newest candidates, at most so many, and whether some were left out, which a caller should say."""
    found = candidates.orderBy(F.col(at).desc(), "sha").limit(most + 1)
    cut = found.count() > most
    return candidates.orderBy(F.col(at).desc(), "sha").limit(most), cut


def mapping_drafts(found: DataFrame, commits: DataFrame) -> DataFrame:
    """Re-anchor mappings as content: detected rewrites (branch, sha, successor, method) by successor, superseded sorted.

    The time is the successor's commit time, so that two replicas make the same event.
    """
    rows = found.join(commits.select(F.col("sha").alias("successor"), "committed_at"), "successor")
    grouped = rows.groupBy("successor", "method", "branch", "committed_at").agg(F.array_sort(F.collect_set("sha")).alias("superseded"))
    return grouped.select(F.lit("re_anchor").alias("kind"), F.col("committed_at").alias("occurred_at"), F.to_json(F.struct("branch", "method", "successor", "superseded")).alias("content_json"), F.col("successor").alias("anchor"))
