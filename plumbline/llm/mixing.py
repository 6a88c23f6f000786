"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network on the driver routes each
pattern's token capacity to the sources' quotas; the e-th repetition of a pattern costs more than the one before it (convex costs),
so data is repeated as little as the quotas allow. Sources that share no pattern with another have the flow in closed form, so only
overlaps are searched. Every pattern's flow is then spent on whole documents in a seeded order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, local_table

#: Bits of the seeded key that one step of the descent settles; rows at the cut that are filled one by one; salts of equal keys; tables of
#: fewer patterns or sources than the last are broadcast.
BITS, FINAL_ROWS, SALTS, SMALL = 10, 512, 256, 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, cycle: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict:
    """Each source's target: weights repeat along the sources by code point (null last) and share ``share`` of
    all sizes; a target stops at ``cap`` times its source's size and the excess is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        free -= set(over)
        left -= sum(out[s] for s in over)
    return out


def route(capacity: dict, members: dict, quota: dict, epochs: int) -> dict:
    """Flow (pattern, source) -> tokens, as ``min_cost_flow`` has it. A pattern of one source that stands in no other pattern fills the
    source's quota as far as it can: there is nothing to choose. Only the other patterns are searched, so what limits the
    search is their number."""
    shared = {p for p, own in members.items() if len(own) > 1}
    uses: dict = {}
    for p, own in members.items():
        for s in own:
            uses[s] = uses.get(s, 0) + 1
    rest = {p for p, own in members.items() if p in shared or any(uses[s] > 1 for s in own)}
    out = {(p, members[p][0]): t for p in members if p not in rest and members[p] and (t := min(quota[members[p][0]], epochs * capacity[p]))}
    if rest:
        own = {s: quota[s] for p in rest for s in members[p]}
        out |= min_cost_flow({p: capacity[p] for p in rest}, {p: members[p] for p in rest}, own, epochs)
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, epochs: int) -> dict:
    """Flow (pattern, source) -> tokens that fills the quotas as far as possible at least cost.

    Successive shortest paths with potentials. Arcs: start -> pattern once for each epoch e, capacity the
    pattern's tokens, cost e * e; pattern -> its sources, free; source -> end, capacity its quota.
    """
    patterns, sources = sorted(capacity), sorted(quota, key=lambda s: (s is None, s or ""))
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    to, cap, cost, out = [], [], [], [[] for _ in range(len(node) + 2)]

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    for p in patterns:
        for e in range(1, epochs + 1):
            arc(0, node["p", p], capacity[p], e * e)
    links = {}
    for p in patterns:
        for s in members[p]:
            links[p, s] = len(to)
            arc(node["p", p], node["s", s], epochs * capacity[p], 0)
    for s in sources:
        arc(node["s", s], 1, quota[s], 0)
    height = [0] * len(out)
    while True:
        far, came, queue = [float("inf")] * len(out), [-1] * len(out), [(0, 0)]
        far[0] = 0
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for a in out[x]:
                if cap[a] > 0 and (n := d + cost[a] + height[x] - height[to[a]]) < far[to[a]]:
                    far[to[a]], came[to[a]] = n, a
                    heapq.heappush(queue, (n, to[a]))
        if far[1] == float("inf"):
            return {k: cap[a + 1] for k, a in links.items() if cap[a + 1]}
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far, strict=True)]
        path, x = [], 1
        while x:
            path.append(came[x])
            x = to[came[x] ^ 1]
        push = min(cap[a] for a in path)
        for a in path:
            cap[a] -= push
            cap[a ^ 1] += push


def _fill(items: list[tuple[int, int, int]], left: int) -> list[tuple[int, int]]:
    """(key, rows taken) of (key, size, rows) in seeded order: what still fits is taken in order; then single additions, removals and
    exchanges bring the sum as near to ``left`` as they can."""
    size, n = np.array([s for _, s, _ in items]), np.array([n for *_, n in items])
    take, gap = np.zeros(len(items), int), left
    for i in range(len(items)):
        take[i] = min(n[i], gap // size[i]) if size[i] else n[i]
        gap -= take[i] * size[i]
    for _ in range(100):
        more, less = np.flatnonzero((take < n) & (size > 0)), np.flatnonzero((take > 0) & (size > 0))
        into, out = np.append(size[more], 0), np.append(size[less], 0)
        after = np.abs(gap - into[:, None] + out[None, :])
        i, j = np.unravel_index(after.argmin(), after.shape)
        if after[i, j] >= abs(gap):
            break
        gap += out[j] - into[i]
        if i < len(more):
            take[more[i]] += 1
        if j < len(less):
            take[less[j]] -= 1
    return [(k, int(t)) for (k, *_), t in zip(items, take, strict=True) if t]


def _choose(scratch: Scratch, rows: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each pattern of ``rest`` (pattern, left) a cut (pattern, shift, cut) of its rows (pattern, key, size), below which all are
    taken, and the rows (pattern, key, take) at the cut that are, so that the sizes come near ``left``. A null cut takes all.

    A radix descent on the seeded key: 2**BITS sums for each pattern and level, along which a window finds the bucket in which
    ``left`` is passed, until at most FINAL_ROWS rows stand there; these fill what is left, a group for each pattern. Only the
    number of patterns that are still open reaches the driver.
    """
    spark, edges, picks = rows.sparkSession, [], []
    open_, level = scratch.keep(rest.where("left > 0").withColumn("prefix", F.lit(0).cast("long")), "open"), 0
    while not open_.isEmpty():
        shift = 62 - BITS * (level + 1)
        key = F.shiftright("key", shift) if shift >= 0 else F.col("key")
        up = F.shiftright("key", shift + BITS) if level else F.lit(0).cast("long")
        inside = rows.select("pattern", "key", "size", up.alias("prefix"), key.alias("b")).join(open_, ["pattern", "prefix"])
        sums = inside.groupBy("pattern", "left", "b").agg(F.sum("size").alias("t"), F.count("*").alias("n"))
        along = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # 2**BITS rows
        passed = F.when(F.col("upto") > F.col("left"), F.struct("b", (F.col("left") - F.col("upto") + F.col("t")).alias("left"), "n"))
        at = sums.withColumn("upto", F.sum("t").over(along)).groupBy("pattern").agg(F.min(passed).alias("at"))
        at = scratch.keep(at.select("pattern", "at.b", "at.left", "at.n"), f"at-{level}")
        edges.append(at.where("b is null").select("pattern", F.lit(0).alias("shift"), F.col("b").alias("cut")))
        last = F.col("n") <= FINAL_ROWS if shift >= BITS else F.lit(True)
        final = at.where(F.col("b").isNotNull() & last)
        edges.append(final.select("pattern", F.lit(shift).alias("shift"), F.col("b").alias("cut")))
        groups = rows.select("pattern", "size", "key", key.alias("b")).join(final, ["pattern", "b"]).groupBy("pattern", "left", "key", "size").agg(F.count("*").alias("n"))
        picks.append(groups.groupBy("pattern").applyInPandas(_filled, "pattern int, key bigint, take bigint"))
        open_ = at.where(F.col("b").isNotNull() & ~last).select("pattern", "left", F.col("b").alias("prefix"))
        level += 1
    both = []
    for parts, schema, name in ((edges, "pattern int, shift int, cut bigint", "edges"), (picks, "pattern int, key bigint, take bigint", "picks")):
        out = local_table(spark, [], schema)
        for p in parts:
            out = out.unionByName(p)
        both.append(scratch.keep(out, name))
    return both[0], both[1]


def _filled(g: pd.DataFrame) -> pd.DataFrame:
    items = sorted(zip(g["key"].tolist(), g["size"].tolist(), g["n"].tolist(), strict=True))
    return pd.DataFrame([(g["pattern"].iloc[0], k, t) for k, t in _fill(items, int(g["left"].iloc[0]))], columns=["pattern", "key", "take"])


def mix(documents: DataFrame, quotas, size: Column, members: Column, epochs: int = 2, seed: int = 5, carry: tuple = ("doc_id",)) -> DataFrame:
    """Choose how many tokens of each document the mix takes.

    ``members`` is an array of the sources that a document belongs to; ``quotas`` maps {source: tokens} (all
    tokens of its documents) to {source: target}. Returns ``carry``, members, size, and taken: 0 to ``epochs``
    times the size. Rows with null members or ids are ordinary rows; identical rows share a key and are taken as
    many times as fits; an empty table gives no rows. One row for each pattern and source goes to the driver, and the flow between
    overlapping patterns is searched there. Choices depend on the rows' contents and ``seed`` alone, so reruns agree.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(
        documents.select(*carry, F.sort_array(members).alias("members"), size.alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), *carry, F.xxhash64("text")), 2).alias("key"), (F.monotonically_increasing_id() % SALTS).alias("salt")), "rows"
    )
    found = rows.groupBy("members").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: repr(r["members"]))
    capacity, belongs = {i: r["size"] for i, r in enumerate(found)}, {i: r["members"] for i, r in enumerate(found)}
    sizes: dict = {}
    for i, own in belongs.items():
        for s in own:
            sizes[s] = sizes.get(s, 0) + capacity[i]
    flow = route(capacity, belongs, {s: round(t) for s, t in quotas(sizes).items()}, epochs)
    spent = {i: 0 for i in capacity}
    for (i, _), t in flow.items():
        spent[i] += t
    full = {i: spent[i] // c if c else 0 for i, c in capacity.items()}
    hint = F.broadcast if len(found) <= SMALL else (lambda x: x)
    index = local_table(spark, [(i, belongs[i], full[i], spent[i] - full[i] * capacity[i]) for i in capacity], "pattern int, members array<string>, full bigint, left bigint")
    index = scratch.keep(index, "index")
    rows = rows.join(hint(index.drop("left")), rows["members"].eqNullSafe(index["members"])).drop(index["members"])
    edge, picked = _choose(scratch, rows.select("pattern", "key", "size"), index.select("pattern", "left"))
    rows = rows.join(hint(edge), "pattern", "left").join(hint(picked), ["pattern", "key"], "left")  # at most FINAL_ROWS keys a pattern
    below = F.col("shift").isNotNull() & (F.col("cut").isNull() | (F.expr("shiftright(key, shift)") < F.col("cut")))
    # rows at the cut that share a key: only so many of them as fit, counted off salt by salt
    at_cut = rows.where("take > 0")
    spots = ["pattern", "key", "salt"]
    counts = at_cut.groupBy(*spots).agg(F.count("*").alias("n"))
    before = counts.select(*spots, F.expr("sum(n) over (partition by pattern, key order by salt) - n").alias("before"))  # SALTS rows a key at most
    at_cut = at_cut.join(before, spots).withColumn("nth", F.col("before") + F.expr("row_number() over (partition by pattern, key, salt order by size)")).drop("before")
    rows = rows.where(~F.coalesce(F.col("take") > 0, F.lit(False))).withColumn("nth", F.lit(1).cast("long")).unionByName(at_cut)
    extra = below | (F.col("nth") <= F.coalesce("take", F.lit(0)))
    return rows.select(*carry, "members", "size", (F.col("size") * (F.coalesce("full", F.lit(0)) + extra.cast("long"))).alias("taken"))


def source_mix(documents: DataFrame, carry: tuple = ("doc_id",)) -> DataFrame:
    """The mix of ``documents`` whose only membership is their source: ``carry``, size, source_size, target, taken.

    A null source is a source of its own, the last; a null or blank text has size 0 and takes nothing. Null ids and repeated
    rows are ordinary rows; of rows that are alike in ``carry`` and text, as many are taken as fit, whichever. An empty
    table gives no rows. Columns of ``documents`` that clash with the results' names aren't carried.
    """
    held: dict = {}

    def quotas(sizes):
        held.update(sizes=sizes, targets=targets(sizes))
        return held["targets"]

    mixed = mix(documents, quotas, word_count(F.col("text")), F.array(F.col("source").cast("string")), carry=carry)
    names = [(s, held["sizes"][s], float(held["targets"][s])) for s in held.get("sizes", {})]
    per = local_table(documents.sparkSession, names, "name string, source_size bigint, target double")
    per = F.broadcast(per) if len(names) <= SMALL else per
    return mixed.join(per, mixed["members"][0].eqNullSafe(per["name"])).select(*carry, "size", "source_size", "target", "taken")
