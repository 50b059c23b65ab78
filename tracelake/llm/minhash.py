"""Operator 5: MinHash near-duplicates with HyperMinHash registers.

A document's set holds the hashes of its distinct k-word shingles, ASCII letters
lower-cased; fewer words make one shingle, none make an empty set that is linked
with nothing.  Two documents are linked if the Jaccard similarity of their whole
sets reaches the threshold; the answer gives each document's connected component.

1. Each hash falls in one of ``BUCKETS`` buckets; of a bucket's smallest hash the
   register stores the count of leading zeros and ``MANTISSA`` bits behind them.
   Empty buckets borrow by a fixed random list of donors, so that two registers
   agree with a probability near the similarity, for short texts too.
2. Documents with equal sets are one class, led by the smallest id.
3. Bands of registers of the leaders are grouped; the chance that a pair at the
   threshold shares no band is below ``MISS``.  Groups with the same members count once.
4. Each group's members are compared with its smallest id: first by the
   collision-corrected estimate from the registers, then exactly on the full sets.
   Only what these full sets confirm is a link, and only links are followed: the
   links' connected components are the clusters so far.
5. Where a group's other members still are in several clusters, those outside the
   largest one are compared with all of them.  Any pair of a group is thus in one
   cluster or has been compared.  The components of all links are the answer.

Comparisons are dealt into tiles of about ``TILE`` members on each side, so a hot group
makes tiles, not pairs; of each tile only the links of a spanning forest leave.  A
group of near copies costs each member's set once and its first member's once a tile.
A pair that several tiles find near goes to the one that finds most, and a set that a tile
needs on both sides is sent to it once.  Bands of one document alone are told by a count, and
sieved out before ids and sums are grouped.
In step 5, where few pairs are near, the tiles first meet with a byte of each register
(whose agreement never falls short of the registers' own), and only the members of pairs
that may reach the threshold bring their sets.
Rows with a null id take no part and get a null component; rows with one id are one
document.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.sieves import sieve
from tracelake.llm.components import components
from tracelake.llm.textkit import U64, mix, padding, partitions, settle, shingle_hashes, texts, trimmed, word_hashes
from tracelake.shared import counted

BUCKETS, MANTISSA, MISS = 384, 10, 1e-6
#: Members of a side of a tile, and their shingles (8 bytes each), on the average at most.
TILE, TILE_SHINGLES = 256, 4 << 20
_TRIES = 64
_donors = np.random.default_rng(5).integers(0, BUCKETS, (_TRIES, BUCKETS))
#: The chance that unequal minima agree in zeros and mantissa.  The density of the
#: smallest of many hashes makes it about 0.17 / 2^bits.
COLLISION = 0.17 / (1 << MANTISSA)
#: Bytes of one ask and of a row of asks' own, and of all asks up to which they are broadcast.
ASK_BYTES, MOST_BROADCAST = 48, 16 << 20
#: Estimates this far below the threshold (over 7 standard errors of 384
#: registers) rule a pair out; sets under LEAST_SET are always compared.
SLACK, LEAST_SET = 0.2, 128
#: Near pairs a member of a tile up to which they are told apart; of more all the tile's near members meet there.
PAIRS = 4


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text."""
    return np.unique(shingle_hashes(word_hashes(data.lower()), k))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted set that is not empty."""
    bucket = ((hashes >> U64(32)) * U64(BUCKETS) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so the first of a bucket is its smallest
    rest = (mix(hashes[first]) >> U64(11)).astype(np.float64)  # 53 bits
    f, e = np.frexp(np.maximum(rest, 1.0))
    packed = ((53 - e) << MANTISSA) | ((f * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = np.full(BUCKETS, 0xFFFF, dtype=np.uint16)
    filled = np.zeros(BUCKETS, dtype=bool)
    filled[bucket[first]] = True
    out[bucket[first]] = packed
    if len(first) < BUCKETS:
        empty = np.flatnonzero(~filled)
        usable = filled[_donors[:, empty]]
        pick = _donors[usable.argmax(axis=0), empty]
        lost = ~usable.any(axis=0)
        if lost.any():  # very short texts: the next filled bucket around
            at = np.flatnonzero(filled)
            pick[lost] = at[np.searchsorted(at, empty[lost]) % len(at)]
        out[empty] = out[pick]
    return out


def rows_per_band(threshold: float) -> int:
    """The most registers a band that keep the chance of a miss below MISS."""
    return max(r for r in (1, 2, 3, 4, 6, 8, 12) if r == 1 or (1 - threshold**r) ** (BUCKETS // r) < MISS)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    parts = regs.reshape(-1, rows).astype(U64)
    key = np.arange(len(parts), dtype=U64)
    for i in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of registers a (one document a row) against b, corrected for chance agreement."""
    same = np.zeros((len(a), len(b)), dtype=np.float32)
    for i in range(len(a)):
        same[i] = (b == a[i]).mean(axis=1)
    return np.maximum(0.0, (same - COLLISION) / (1 - COLLISION))


def candidates(a: np.ndarray, left_regs: np.ndarray, b: np.ndarray, right_regs: np.ndarray, percent: float, maybe: np.ndarray) -> np.ndarray:
    """Of the pairs that maybe asks for, those that sizes and estimates don't rule out; a and b are the sets' sizes."""
    small, large = np.minimum.outer(a, b), np.maximum.outer(a, b)
    maybe = maybe & (100 * small >= percent * large)
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return maybe
    near = np.zeros_like(maybe)
    near[np.ix_(rows, cols)] = estimate(left_regs[rows], right_regs[cols]) >= percent / 100 - SLACK
    return maybe & (near | (small < LEAST_SET))


def linked(left: list[np.ndarray], left_regs: np.ndarray, right: list[np.ndarray], right_regs: np.ndarray, percent: float, maybe: np.ndarray) -> np.ndarray:
    """Which pairs of left and right documents reach the threshold, of those that maybe asks for: a boolean matrix, exact."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    maybe = candidates(a, left_regs, b, right_regs, percent, maybe)
    if not maybe.any():
        return maybe
    both = np.zeros(maybe.shape, dtype=np.int64)
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if maybe.sum() <= 4 * (len(rows) + len(cols)):
        for i, j in zip(*np.nonzero(maybe)):
            both[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:  # a product of 0/1 matrices, some thousand shingles at a time
        one, two = (np.repeat(np.arange(len(at)), n[at]) for at, n in ((rows, a), (cols, b)))
        every, term = np.unique(np.concatenate([left[i] for i in rows] + [right[j] for j in cols]), return_inverse=True)
        x, y = term[: len(one)], term[len(one) :]
        one, x = one[o := np.argsort(x, kind="stable")], x[o]
        two, y = two[o := np.argsort(y, kind="stable")], y[o]
        width, total = 4096, np.zeros((len(rows), len(cols)))
        for c in range(0, len(every), width):
            dense = []
            for doc, at, n in ((one, x, len(rows)), (two, y, len(cols))):
                f, t = np.searchsorted(at, [c, c + width])
                dense.append(np.zeros((n, width), dtype=np.float32))
                dense[-1][doc[f:t], at[f:t] - c] = 1.0
            total += dense[0] @ dense[1].T
        both[np.ix_(rows, cols)] = np.rint(total).astype(np.int64)
    return maybe & (100 * both >= percent * (a[:, None] + b[None, :] - both))


def forest(ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for the ids that a link matrix ties."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        near = np.where(link, label[None, :], top).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            break
        label = new
    return [(int(i), int(m)) for i, m in zip(ids, label) if i != m]


def _features(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, the set's 128-bit key, band keys) of each document."""

    def run(batches):
        for b in batches:
            sizes, one, two, bands = [], [], [], []
            for t in texts(b.column(1)):
                s = shingle_set(t, k)
                sizes.append(len(s))
                one.append(int(s.sum(dtype=U64).view(np.int64)) if len(s) else 0)
                two.append(int(mix(s ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                bands.append(band_keys(registers(s), rows).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            lengths = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], ["doc_id", "n_shingles", "one", "two", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, one long, two long, bands array<long>")


#: What a document is asked for: side 0 (member) or 1 (compared with all members) of a
#: group, its block of that side, the blocks from..till of the other side, its cluster so far.
#: Side 2 is both sides of one tile, with the block of side 0.
_ASK = "struct<group:long,side:int,block:long,from:long,till:long,cluster:long>"


def _sent(docs: DataFrame, k: int, whole: bool) -> DataFrame:
    """A row for each tile that a document (doc_id, text, asks) is in: group, i, j, side, id, cluster, size of the set, regs, set.

    If not whole, regs are a byte of each register and there is no set.
    """

    def run(batches):
        names = ["group", "i", "j", "side", "id", "cluster", "size", "regs", "set"]
        types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()] * 2

        def rows(out):
            cols = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            out, held = [], 0
            for doc, t, asks in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                s = shingle_set(t, k)
                if not len(s):
                    continue
                data = (registers(s).tobytes(), s.tobytes()) if whole else (registers(s).astype(np.uint8).tobytes(), None)
                for ask in asks:
                    for other in range(ask["from"], ask["till"]):
                        at = (ask["block"], other) if ask["side"] != 1 else (other, ask["block"])
                        out.append((ask["group"], *at, ask["side"], doc, ask["cluster"], len(s), *data))
                        held += len(data[1] or b"") + 1000
                        if held > 16 << 20:
                            yield rows(out)
                            out, held = [], 0
            yield rows(out)

    return docs.select("doc_id", "text", "asks").mapInArrow(trimmed(run), "group long, i long, j long, side int, id long, cluster long, size long, regs binary, set binary")


def _by_tile(tiles: DataFrame, solve, result, schema: str) -> DataFrame:
    """What solve(tile, rows) gives of each tile, put into batches by result; a row is (side, id, cluster, size, regs, set)."""
    tiles = tiles.repartition(partitions(tiles.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            for at, *rest, r, s in zip(zip(*(b.column(i).to_pylist() for i in range(3))), *(b.column(i).to_pylist() for i in range(3, 7)), b.column(7), b.column(8)):
                if at != key:
                    out += solve(key, held)
                    key, held = at, []
                held.append((*rest, r.as_py(), s.as_py()))
            yield result(out)
        yield result(solve(key, held))

    return tiles.mapInArrow(trimmed(run), schema)


def _apart(ids, clusters) -> np.ndarray:
    return (ids[0][:, None] != ids[1][None, :]) & (clusters[0][:, None] != clusters[1][None, :])


def _screened(tiles: DataFrame, percent: float) -> DataFrame:
    """(doc_id, ask): members of tiles that are in a pair which may reach the threshold, asked for again.

    Each such pair is asked for in one tile, that with the most of them.
    """
    names = ["a", "b", "pairs", "group", "i", "j", "side", "mine", "other"]  # a's side and cluster, b's cluster; without b a alone is asked for

    def solve(key, rows):
        sides = [[r for r in rows if r[0] == i] for i in (0, 1)]
        if not sides[0] or not sides[1]:
            return []
        column = lambda j: [np.array([r[j] for r in x], dtype=np.int64) for x in sides]
        ids, clusters, sizes = column(1), column(2), column(3)
        regs = [np.stack([np.frombuffer(r[4], dtype=np.uint8) for r in x]) for x in sides]
        maybe = candidates(sizes[0], regs[0], sizes[1], regs[1], percent, _apart(ids, clusters))
        x, y = np.nonzero(maybe)
        pairs: dict = {}
        for left, right, one, two in zip(ids[0][x].tolist(), ids[1][y].tolist(), clusters[0][x].tolist(), clusters[1][y].tolist()):
            if left < right:
                pairs[left, right] = (0, one, two)
            else:
                pairs.setdefault((right, left), (1, two, one))
        members = {i for pair in pairs for i in pair}
        if len(pairs) <= PAIRS * len(members):
            return [(*pair, len(pairs), *key, *how) for pair, how in pairs.items()]
        near = [dict(zip(i[n].tolist(), c[n].tolist())) for i, c, n in zip(ids, clusters, (maybe.any(axis=1), maybe.any(axis=0)))]
        return [(i, None, len(pairs), *key, 2 if i in near[0] and i in near[1] else int(i in near[1]), (near[0] | near[1])[i], None) for i in near[0] | near[1]]

    def result(out):
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    found = settle(_by_tile(tiles, solve, result, ", ".join(f"{n} long" for n in names)), "nd-near")
    owned = found.where("b is not null").groupBy("a", "b").agg(F.max(F.struct(*names[2:])).alias("best")).select("a", "b", "best.*")
    tile = ["group", "i", "j"]
    asked = found.where("b is null").select(F.col("a").alias("doc_id"), *tile, "side", F.col("mine").alias("cluster"))
    asked = asked.unionByName(owned.select(F.col("a").alias("doc_id"), *tile, "side", F.col("mine").alias("cluster")))
    asked = asked.unionByName(owned.select(F.col("b").alias("doc_id"), *tile, (1 - F.col("side")).alias("side"), F.col("other").alias("cluster")))
    asked = asked.groupBy("doc_id", *tile, "cluster").agg(F.min("side").alias("least"), F.max("side").alias("side"))
    side = F.when(F.col("least") < F.col("side"), 2).otherwise(F.col("side").cast("int"))
    mine, other = (F.when(side == 1, F.col(x)).otherwise(F.col(y)) for x, y in (("j", "i"), ("i", "j")))
    return asked.select("doc_id", F.struct("group", side, mine, other, other + 1, "cluster").cast(_ASK).alias("ask"))


def _tile_links(tiles: DataFrame, percent: float) -> DataFrame:
    """Spanning-forest links (a, b) of each tile's documents."""

    def solve(_, rows):
        sides = ({}, {})
        for side, i, cluster, _, r, s in rows:  # rows that share an id may differ in text
            for n in (0, 1) if side == 2 else (side,):
                sides[n].setdefault((i, s), (cluster, r))
        if not sides[0] or not sides[1]:
            return []
        ids = [np.array([i for i, _ in x], dtype=np.int64) for x in sides]
        clusters = [np.array([c for c, _ in x.values()], dtype=np.int64) for x in sides]
        sets = [[np.frombuffer(s, dtype=U64) for _, s in x] for x in sides]
        regs = [np.stack([np.frombuffer(r, dtype=np.uint16) for _, r in x.values()]) for x in sides]
        found = linked(sets[0], regs[0], sets[1], regs[1], percent, _apart(ids, clusters))
        if found.shape[1] == 1:
            return [(int(i), int(ids[1][0])) for i in ids[0][found[:, 0]]]
        n = len(ids[0])
        link = np.zeros((n + len(ids[1]),) * 2, dtype=bool)
        link[:n, n:], link[n:, :n] = found, found.T
        return forest(np.concatenate(ids), link)

    def result(out):
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_tile(tiles, solve, result, "a long, b long")


def _met(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """(doc_id, text, asks) of the documents that are asked for; asks holds (doc_id, ask)."""
    asks = settle(asks.groupBy("doc_id").agg(F.collect_list("ask").alias("asks")), "nd-asks")  # some for each band at most
    size = asks.agg(F.sum(F.size("asks").cast("long") * ASK_BYTES + 2 * ASK_BYTES)).first()[0] or 0
    if size <= MOST_BROADCAST:  # texts stay where they are; beyond that, texts and asks meet in a shuffle
        asks = F.broadcast(asks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asks, "doc_id")


def _verified(docs: DataFrame, asks: DataFrame, k: int, percent: float) -> DataFrame:
    """Links (a, b) among the documents asked for."""
    return settle(_tile_links(_sent(_met(docs, asks), k, True), percent), "nd-found")


def _blocks(n: str, shingles: str) -> Column:
    """How many blocks a side of so many members and shingles makes."""
    return F.ceil(F.greatest(F.col(n) / TILE, F.col(shingles) / TILE_SHINGLES, F.lit(1.0)))


def _ask(group: str, side: int, mine: str, others: str, cluster: str) -> Column:
    block = F.pmod(F.xxhash64("doc_id", F.lit(3 + side)), F.col(mine))
    parts = [F.col(group).cast("long"), F.lit(side), block, F.lit(0).cast("long"), F.col(others).cast("long"), F.col(cluster).cast("long")]
    return F.struct(*parts).cast(_ASK).alias("ask")


def _first_asks(ties: DataFrame) -> DataFrame:
    """(doc_id, ask): each member of a group against the group's smallest id."""
    pairs = ties.where("doc_id <> leader").select("leader", "doc_id", "n_shingles").distinct()
    per = settle(pairs.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).select("leader", _blocks("n", "size").alias("blocks")), "nd-leaders")
    one = F.lit(1).cast("long")
    members = pairs.join(per, "leader").withColumn("one", one).select("doc_id", _ask("leader", 0, "blocks", "one", "doc_id"))
    return members.unionByName(per.withColumns({"doc_id": F.col("leader"), "one": one}).select("doc_id", _ask("leader", 1, "one", "blocks", "leader")))


def _rest_asks(ties: DataFrame, clusters: DataFrame) -> DataFrame | None:
    """(doc_id, ask): in groups of several clusters, the members outside the largest one against all; None if there are none.

    A group's smallest id has met all of its members already, so it stays out.
    """
    tied = ties.where("doc_id <> leader").join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("known")), "doc_id", "left")
    tied = settle(tied.withColumn("cluster", F.coalesce("known", "doc_id")).drop("known"), "nd-tied")
    per = tied.groupBy("band", "cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    big = F.max(F.struct("n", F.bitwise_not("cluster").alias("cluster"), "size"))
    per = per.groupBy("band").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.sum("size").alias("size"), big.alias("big")).where("clusters > 1")
    per = per.select("band", F.bitwise_not("big.cluster").alias("most"), "n", "size", (F.col("n") - F.col("big.n")).alias("m"), (F.col("size") - F.col("big.size")).alias("rest"))
    per = settle(per.select("band", "most", _blocks("n", "size").alias("blocks"), _blocks("m", "rest").alias("others")), "nd-open")
    if per.isEmpty():
        return None
    tied = tied.join(per, "band")
    return tied.select("doc_id", _ask("band", 0, "blocks", "others", "cluster")).unionByName(tied.where("cluster <> most").select("doc_id", _ask("band", 1, "others", "blocks", "cluster")))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    percent = round(100 * threshold, 6)
    found = settle(_features(docs, k, rows_per_band(threshold)), "nd-features")
    real = found.where("doc_id is not null and n_shingles > 0")
    classes = settle(real.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("leader")), "nd-classes")
    led = real.join(classes, ["n_shingles", "one", "two"]).select("doc_id", "n_shingles", "leader", "bands")
    led = settle(led.withColumn("bands", F.when(F.col("doc_id") == F.col("leader"), F.col("bands"))), "nd-led")
    keyed = led.where("doc_id = leader").select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    # most bands are of one document: a count, without ids and sums, tells the others
    bands, n = counted(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "nd-bands")
    keyed = settle(keyed.where(sieve(bands, n)("band")), "nd-keyed")
    # groups of the same members, told by two sums without carry of their ids' hashes, count once
    same = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    groups = keyed.groupBy("band").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("n"), *same).where("leader < last")
    groups = settle(groups.groupBy("leader", "n", "x1", "x2").agg(F.min("band").alias("band")).select("band", "leader"), "nd-groups")
    ties = settle(keyed.join(groups, "band").select("band", "leader", "doc_id", "n_shingles"), "nd-ties")
    own = led.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    shared = settle(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "nd-shared")
    # rows that share an id lead their classes together
    repeated = led.join(shared, "doc_id").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    links = _verified(docs, _first_asks(ties), k, percent).unionByName(own).unionByName(repeated)
    tied = settle(components(links), "nd-clusters")
    asks = _rest_asks(ties, tied)
    if asks is not None:
        more = _verified(docs, _screened(_sent(_met(docs, asks), k, False), percent), k, percent)
        if not more.isEmpty():
            tied = components(tied.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    tied = tied.select(F.col("id").alias("doc_id"), "component", F.lit(0).cast("long").alias("_pad"))
    out = found.select("doc_id", "n_shingles", padding(docs.sparkSession, "doc_id").alias("_pad")).join(tied, ["doc_id", "_pad"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
