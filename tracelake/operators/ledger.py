"""The ledger's sinks: idempotent append, pending queue, replica union, scoped push and its gate, incremental capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.rules import Rule
from tracelake.operators import commits, graph, reading, redaction, scanning, screens
from tracelake.shared import bytes_of, counted, exists, scope
from tracelake.sources.tables import problems

#: Parts into which a ledger is laid out by its anchors.
PARTS = 64
#: Bytes of parts to read from which on an append asks a screen first.
SCREEN_FROM = 64 << 20


def new_rows(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of a batch that an append adds: one an (anchor, id), and none that the anchor holds already."""
    once = Window.partitionBy("anchor", "id").orderBy("recorded_at", "content_json")
    batch = batch.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_nth")
    old = existing.select(F.col("anchor").alias("_a"), F.col("id").alias("_i"))
    return batch.join(old, batch["anchor"].eqNullSafe(old["_a"]) & (batch["id"] == old["_i"]), "left_anti")


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at a path, None where nothing was written there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


def part_of(anchor: Column) -> Column:
    """The part of the ledger that holds an anchor; pending events have one of their own."""
    return F.when(anchor.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(anchor), F.lit(PARTS))).cast("int")


def append(batch: DataFrame, path: str, enabled: bool = True, rules: list[Rule] | None = None, exact: dict[str, list[str]] | None = None, drain_to: str | None = None, screen_from: int = SCREEN_FROM) -> dict[str, int]:
    """Append a batch of events to the ledger at a path; how many rows were added and how many were there already.

    Contents and raw lines are redacted by the rules (None: capture's, an empty list:
    none) and exact values before ids are made.  An event that is not sound is an error,
    and nothing is written.  The ledger is laid out by parts of its anchors, of which
    only the batch's are read; the rows to add are written beside the ledger's own
    files by one job, so a batch that is sent again adds nothing.  Writers of one ledger
    take turns (see commits).  With drain_to, events that wait for an anchor get this one first.

    Once the parts to read take screen_from bytes, a screen of ids is kept beside the ledger
    (see screens), and of the parts only those are read that may hold some of the batch's ids.
    """
    spark = batch.sparkSession
    if not enabled:
        return {"appended": 0, "deduped": 0}
    if drain_to is not None:
        drain_stored(spark, path, drain_to)
    with scope(spark):
        batch = graph.cut(redaction.redact_events(batch, rules, exact).withColumn("part", part_of(F.col("anchor"))))
        total = batch.agg(F.count("*").alias("n"), F.count_if(F.size(problems()) > 0).alias("bad"), F.collect_set("part").alias("parts")).first()  # PARTS numbers at most
        if total["bad"]:
            raise ValueError(f"{total['bad']} events are not sound")

        def write(number: int) -> dict[str, int]:
            existing, look = table(spark, path, batch.schema), total["parts"]
            screen = screens.Screen(spark, path)
            held = bool(screen.filters())
            if held or sum(bytes_of(spark, f"{path}/part={p}") for p in look) >= screen_from:
                if held:
                    look = parts_known(batch, screen)
                screen.grow(batch, number, existing)
            existing = batch.limit(0) if existing is None or not look else existing.where(F.col("part").isin(look))
            seen = Observation()
            new_rows(batch, existing).observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("part").parquet(path)
            return {"appended": seen.get["n"], "deduped": total["n"] - seen.get["n"]}

        return commits.appended(spark, path, write)


def parts_known(batch: DataFrame, screen: screens.Screen) -> list[int]:
    """The parts of a batch's rows whose ids a screen knows."""
    return sorted(r.part for r in batch.join(screen.may_hold(batch), "id", "left_semi").select("part").distinct().collect())  # PARTS numbers at most


def drain(ledger: DataFrame, anchor: str) -> DataFrame:
    """The ledger with its pending events given to an anchor, where that does not hold them."""
    pending = ledger.where(F.col("anchor").isNull()).withColumn("anchor", F.lit(anchor))
    held = ledger.where(F.col("anchor").isNotNull())
    return held.unionByName(new_rows(pending, held))


def parts_of(spark: SparkSession, *anchors: str | None) -> list[int]:
    """The parts of these anchors."""
    return sorted({r.part for r in spark.createDataFrame([(a,) for a in anchors], "anchor string").select(part_of(F.col("anchor")).alias("part")).collect()})


def drain_stored(spark: SparkSession, path: str, anchor: str) -> None:
    """Give the pending events of the ledger at a path to an anchor: its part is written anew, and that of pending events empties."""
    if not exists(spark, f"{path}/part=-1"):
        return
    commits.rewritten(spark, path, parts_of(spark, None, anchor), lambda rows: drain(rows, anchor).withColumn("part", part_of(F.col("anchor"))))


def redact_in_place(spark: SparkSession, path: str, ids: DataFrame, shared: DataFrame | None, pattern: str | None = None, reason: str | None = None) -> int:
    """Redact events of the ledger at a path under their old ids, and add a redaction event each; how many events were.

    See redaction.redact_stored for what is refused.  The parts that hold the events are
    written anew; others are not read but for their ids.
    """
    with scope(spark):
        targets = graph.cut(ids.select("id").distinct())
        held = spark.read.parquet(path).select("id", "part").join(targets, "id", "left_semi")
        where = {r.part: r.n for r in held.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS numbers at most
        if where:
            change = lambda rows: redaction.redact_stored(rows.drop("part"), targets, shared, pattern, reason)[0].withColumn("part", part_of(F.col("anchor")))
            commits.rewritten(spark, path, sorted(where), change, ids=True)
    return sum(where.values())


def digests(events: DataFrame) -> DataFrame:
    """(anchor, n, h): of each anchor its lines' number and four sums over halves of two hashes, whatever the lines' order.

    One row an anchor and task is shuffled, no line.
    """
    one, two = (F.xxhash64(*events.columns, F.lit(seed)) for seed in (1, 2))
    halves = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in (one, two)] + [F.shiftright(x, 32) for x in (one, two)]
    return events.groupBy("anchor").agg(F.count("*").alias("n"), F.struct(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)]).alias("h"))


def differing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(anchor, local_lines, remote_lines) of the anchors that two replicas do not hold alike."""
    mine, theirs = digests(local), digests(remote.select(local.columns)).toDF("_a", "_n", "_h")
    met = mine.join(theirs, mine["anchor"].eqNullSafe(theirs["_a"]), "full")
    none = F.lit(0).cast("long")
    return met.where(~F.col("h").eqNullSafe(F.col("_h"))).select(F.coalesce("anchor", "_a").alias("anchor"), F.coalesce("n", none).alias("local_lines"), F.coalesce("_n", none).alias("remote_lines"))


def union(*replicas: DataFrame) -> DataFrame:
    """Replicas merged: the distinct lines of each anchor, whatever the order of merging."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.distinct()


def merge(local: DataFrame, remote: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The remote with the local lines of anchors in scope (None: all) merged in; only anchors that differ are touched.

    Replicas hold a line once, so of anchors with equal digests nothing is moved, and the
    lines of the others meet by anchor alone.
    """
    columns = remote.columns
    local = local.select(columns)
    if anchors is not None:
        scope, n = counted(anchors.select("anchor").distinct(), "anchors")
        scope = F.broadcast(scope) if n <= reading.SENT else scope
        local = local.join(scope, local["anchor"].eqNullSafe(scope["anchor"]), "left_semi")
    odd, n = counted(differing(local, remote).where("local_lines > 0").select("anchor"), "odd")
    odd = F.broadcast(odd) if n <= reading.SENT else odd  # a hot anchor's lines stay spread
    of = lambda rows, how: rows.join(odd, rows["anchor"].eqNullSafe(odd["anchor"]), how)
    return of(remote, "left_anti").unionByName(union(of(remote, "left_semi"), of(local, "left_semi")))


def push(local: DataFrame, remote: DataFrame, anchors: DataFrame) -> DataFrame:
    """The remote after a push of the anchors in scope: theirs is the union, other anchors stay as they were."""
    return merge(local, remote, anchors)


def unshared(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local events whose id the remote does not hold anywhere."""
    return local.join(remote.select("id").distinct(), "id", "left_anti")


def gate(local: DataFrame, remote: DataFrame, anchors: DataFrame, allowed: DataFrame, tier: str = "standard") -> DataFrame:
    """Findings that block a push: in unshared events in scope, and on no allow list."""
    candidates = unshared(reading.of_anchors(local, anchors), remote)
    return scanning.outstanding(scanning.scan_events(candidates, tier), allowed)


class Held(Exception):
    """A push that findings hold back."""


def sync(local: DataFrame, remote: DataFrame, anchors: DataFrame | None, allowed: DataFrame, tier: str = "standard", skip_scan: bool = False, strict: bool = True) -> tuple[DataFrame, int]:
    """(the remote after a sync, findings that held it back): the gate's policy around a push.

    anchors None pushes the whole ledger, an empty scope nothing.  Tier off or skip_scan
    pass the gate.  Findings abort a strict sync; one that rides on a push of code leaves
    the remote as it is and says how many there were.
    """
    scope = local.select("anchor").where(F.col("anchor").isNotNull()).distinct() if anchors is None else anchors
    if tier != "off" and not skip_scan:
        found = gate(local, remote, scope, allowed, tier).count()
        if found and strict:
            raise Held(f"{found} findings are on no allow list")
        if found:
            return remote, found
    return push(local, remote, scope), 0


def resume(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines (file, seq, value) behind each file's cursor (file, count); a file without one is read from its start.

    A cursor behind the file's end means that the file was rewritten; it is read anew.
    """
    sizes = lines.groupBy("file").agg(F.max("seq").alias("_top"))
    rows = lines.join(sizes.join(cursors.select("file", "count"), "file", "left"), "file")
    start = F.when(F.col("count") > F.col("_top") + 1, 0).otherwise(F.coalesce("count", F.lit(0)))
    return rows.where(F.col("seq") >= start).select(lines.columns)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with state: sound, bad (no JSON), or torn (no JSON, the last of a file that does not end with a line break).

    lines holds file, seq, value and closed, which tells whether the file's last line is ended.
    """
    last = F.col("seq") == F.max("seq").over(Window.partitionBy("file"))
    ok = F.try_parse_json("value").isNotNull()
    return lines.withColumn("state", F.when(ok, "sound").when(last & ~F.col("closed"), "torn").otherwise("bad"))


def cursors(states: DataFrame) -> DataFrame:
    """(file, count): how many lines of each file are done; a torn line is held back."""
    return states.groupBy("file").agg((F.max("seq") + 1 - F.max(F.when(F.col("state") == "torn", 1).otherwise(0))).alias("count"))


def stale(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (file, size) that grew since their cursor (file, size) was written."""
    return files.join(seen.select("file", F.col("size").alias("_size")), "file").where("size > _size").drop("_size")


def settled(calls: Column) -> Column:
    """Whether every tool call (result, status) has a result or a status that is final."""
    final = ("success", "completed", "error", "cancelled", "canceled")
    return F.forall(calls, lambda c: c["result"].isNotNull() | c["status"].isin(*final))


def pushed_refs(lines: DataFrame) -> DataFrame:
    """(ref, sha) from a push's lines (value) of ref and commit: those with a commit that is not all zeros."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).alias("ref"), F.get(parts, F.lit(1)).alias("sha"))
    return rows.where(F.col("sha").rlike("^[0-9a-f]{40,64}$") & ~F.col("sha").rlike("^0+$"))


def tallies(*parts: DataFrame) -> DataFrame:
    """Capture tallies (name, n) of several runs added up."""
    return union_all(*parts).groupBy("name").agg(F.sum("n").alias("n"))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def maintain(local: DataFrame, staged: DataFrame | None, commits: DataFrame, tips: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, anchors in view): what a read does first, a staged replica absorbed and mappings followed from the tips."""
    merged = local if staged is None else union(local, staged.select(local.columns))
    view = graph.reanchor(graph.ancestors(commits, tips), mappings)
    return merged, view.select(F.col("sha").alias("anchor"))
