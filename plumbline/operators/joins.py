"""Lookups, memberships, band joins, neighbours and key linkage."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept_table, written_table
from .neighbours import nearest_rows  # noqa: F401  joins by vector

#: Rows up to which a lookup table is broadcast; a larger one is joined by shuffle.
SMALL = 100_000


def lookup(df: DataFrame, table: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join with a table of one row a key; where there is no row or value, the default. The table's size is checked
    before it is broadcast."""
    small = table.limit(SMALL + 1).count() <= SMALL
    out = df.join(F.broadcast(table) if small else table, on, "left")
    return out.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns))


def member_flag(df: DataFrame, members: DataFrame, key: str, name: str = "seen") -> DataFrame:
    """Whether a row's key occurs among ``members``."""
    return df.join(members.select(key).distinct().withColumn(name, F.lit(1)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def count_shift(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Full join of two frames' value counts, with shares and their ratio (null if the value is missing on one side)."""
    def side(df: DataFrame, s: str) -> DataFrame:
        n = df.groupBy(col).agg(F.count("*").alias(f"n_{s}"))
        return n.crossJoin(n.agg(F.sum(f"n_{s}").alias(f"all_{s}")))  # one row

    both = side(a, "a").join(side(b, "b"), col, "full_outer")
    sa, sb = F.col("n_a") / F.col("all_a"), F.col("n_b") / F.col("all_b")
    return both.select(col, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), (sa / sb).alias("ratio"))


def affiliation_edges(df: DataFrame, code: str, order: list[str], node: str, max_neighbours: int = 3, max_group: int = 1000) -> DataFrame:
    """Edges (src, dst) from each row to the next ``max_neighbours`` rows of its code; groups above ``max_group`` have none."""
    w = Window.partitionBy(code)
    rows = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") <= max_group)
    later = {f"_to{i}": F.lead(node, i).over(w.orderBy(*order)) for i in range(1, max_neighbours + 1)}
    out = rows.withColumns(later).select(F.col(node).alias("src"), F.explode(F.array(*later)).alias("dst"))
    return out.where(F.col("dst").isNotNull())


def connected(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``nodes`` with the least node that each is connected with. Labels spread along edges (a, b) and jump to their label's label, so a
    chain takes rounds in the logarithm of its length. Edges' ends that aren't in ``nodes`` link their neighbours all the same."""
    links = edges.select("a", "b").where("a is not null and b is not null and a != b")
    links = written_table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    own = nodes.select(F.col(node).alias("node")).where(F.col(node).isNotNull())
    labels = written_table(own.unionByName(links.select(F.col("a").alias("node"))).distinct().withColumn("label", F.col("node")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        fresh = written_table(low.join(top, "label").select("node", "old", F.least("label", "top").alias("label")))
        if fresh.where("label != old").isEmpty():
            return own.distinct().join(fresh, "node").select(F.col("node").alias(node), F.col("label").alias("group"))
        labels = fresh.drop("old")


#: Halvings of a cell's side, two at a time, after which undecided boxes are taken apart into points; and pairs of points a point, or in
#: all, up to which that is done at once.
DEEPEST, PAIRS, FEW_PAIRS = 20, 32, 1_000_000


def grid(df: DataFrame, key: str, coordinates: list[str], radius: float) -> tuple[DataFrame, list[str], list[str]]:
    """Distinct points (xs, cs, p, n): coordinates, those of their cell, their least key and number of rows; and the names of both. A cell's
    diagonal is the radius. Rows with a coordinate that is null or not finite are left out."""
    n, side = len(coordinates), radius / len(coordinates) ** 0.5
    xs, cs = [f"x{i}" for i in range(n)], [f"c{i}" for i in range(n)]
    known = df.select(key, *(F.col(c).cast("double").alias(x) for x, c in zip(xs, coordinates, strict=True))).na.drop(subset=xs)
    for x in xs:
        known = known.where(F.abs(x) < float("inf"))
    points = known.groupBy(*xs).agg(F.min(key).alias("p"), F.count("*").alias("n"))
    return points.withColumns({c: F.floor(F.col(x) / side) for c, x in zip(cs, xs, strict=True)}), xs, cs


def _around(n: int) -> list[tuple[int, ...]]:
    """Moves to the cells that a radius can reach."""
    reach = math.ceil(n**0.5)
    return list(product(range(-reach, reach + 1), repeat=n))


def _moved(df: DataFrame, moves: list[tuple[int, ...]], cs: list[str]) -> DataFrame:
    """Each row once for each move, its cell moved."""
    step = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"m{i}") for i, v in enumerate(m))) for m in moves)))
    return df.withColumn("_m", step).withColumns({c: F.col(c) + F.col(f"_m.m{i}") for i, c in enumerate(cs)}).drop("_m")


def linked_cells(points: DataFrame, xs: list[str], cs: list[str], radius: float) -> DataFrame:
    """(a, b): pairs of cells (column cell) of which two points are within ``radius``.

    Points are not compared one by one: boxes are, by their points' bounds. If all of two boxes' points must be within the radius, or
    none can be, that is settled; only boxes in between are cut in four along each side and compared again, down to single points.
    """
    side, square = radius / len(xs) ** 0.5, radius * radius
    first = points.groupBy("cell", *cs).agg(F.lit(1).alias("_"))
    near = _moved(first.select(F.col("cell").alias("a"), *cs), [m for m in _around(len(xs)) if m > (0,) * len(xs)], cs).join(first.select(F.col("cell").alias("b"), *cs), cs)
    root = F.array(*(F.lit(0).cast("double") for _ in xs))
    open_, out, level, last = kept_table(near.select("a", root.alias("ka"), "b", root.alias("kb"))), None, 0, -1
    most_pairs, left = max(FEW_PAIRS, PAIRS * points.count()), open_.count()
    while left:
        inside = lambda k: F.array(*(F.floor((F.col(x) / side - F.col(c)) * 4.0**k).cast("double") for x, c in zip(xs, cs, strict=True)))
        parent = root if last < 0 else inside(last)
        own = inside(level) if level < DEEPEST else F.array(*xs)
        bounds = [f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        boxes = points.groupBy("cell", parent.alias("up"), own.alias("k")).agg(F.count("*").alias("n"), *bounds)
        one, two = (boxes.select(F.col("cell").alias(c), F.col("up").alias(f"k{c}"), F.col("k").alias(f"_{c}"), F.col("n").alias(f"n{c}"), *(F.col(f"{n}{i}").alias(f"{c}{n}{i}") for i in range(len(xs)) for n in ("lo", "hi"))) for c in "ab")
        met = open_.select("a", "ka", "b", "kb").join(one, ["a", "ka"]).join(two, ["b", "kb"])
        gaps = [F.greatest(F.lit(0.0), F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}")) for i in range(len(xs))]
        wide = [F.greatest(F.col(f"bhi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"blo{i}")) for i in range(len(xs))]
        least, most = (sum((v * v for v in d[1:]), d[0] * d[0]) for d in (gaps, wide))
        met = kept_table(met.select("a", F.col("_a").alias("ka"), "b", F.col("_b").alias("kb"), (F.col("na") * F.col("nb")).alias("pairs"), (most <= square).alias("sure"), (least <= square).alias("may")).where("may"))
        sure = met.where("sure").select("a", "b").distinct()
        out = sure if out is None else out.unionByName(sure)
        open_ = kept_table(met.where("not sure").select("a", "ka", "b", "kb", "pairs").join(sure, ["a", "b"], "left_anti"))
        left = open_.agg(F.sum("pairs")).first()[0]
        last, level = level, DEEPEST if (left or 0) <= most_pairs else level + 1
    return near.select("a", "b").limit(0) if out is None else out


def radius_groups(df: DataFrame, key: str, coordinates: list[str], radius: float) -> DataFrame:
    """(key, group): rows whose coordinates are within ``radius`` (Euclidean), linked through others or not, named by their least key.

    Rows of equal coordinates are one point. Points fall into the cells of a grid whose diagonal is the radius, so a cell's points are
    one group; cells are linked if two of their points are. On a line, groups lie between gaps. Rows with a null coordinate are in no group.
    """
    points, xs, cs = grid(df, key, coordinates, radius)
    if len(xs) == 1:
        return _line_groups(df, key, coordinates[0], points.select("x0", "p"), radius)
    points = kept_table(points)
    points = kept_table(points.join(points.groupBy(*cs).agg(F.min("p").alias("cell")), cs))
    groups = connected(linked_cells(points, xs, cs, radius), points.select("cell"), "cell")
    known = df.select(key, *(F.col(c).cast("double").alias(x) for x, c in zip(xs, coordinates, strict=True)))
    return known.join(points.select(*xs, "cell"), xs).join(groups, "cell").select(key, "group")


def _line_groups(df: DataFrame, key: str, coordinate: str, points: DataFrame, radius: float) -> DataFrame:
    """``radius_groups`` of points (x0, p) on a line: gaps are counted within ranges, set off by the ranges' numbers of gaps."""
    from .aggregates import _cuts, _part, parts_of

    points = kept_table(points)
    parted = points.withColumn("_part", _part("x0", _cuts(points, "x0", parts_of(points))))
    w = Window.partitionBy("_part").orderBy("x0")
    gaps = parted.withColumn("_gap", (F.coalesce(F.col("x0") - F.lag("x0").over(w), F.lit(0.0)) > radius).cast("long"))
    ends = gaps.groupBy("_part").agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"), F.sum("_gap").alias("_s"))
    order = Window.orderBy("_part")  # a row for each part
    ends = ends.withColumn("_seam", (F.coalesce(F.col("lo") - F.lag("hi").over(order), F.lit(0.0)) > radius).cast("long"))
    ends = ends.select("_part", (F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_seam").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_before"))
    placed = gaps.withColumn("_g", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(ends), "_part").select("x0", "p", (F.col("_g") + F.col("_before")).alias("_g"))
    named = placed.join(placed.groupBy("_g").agg(F.min("p").alias("group")), "_g").select("x0", "group")
    return df.select(key, F.col(coordinate).cast("double").alias("x0")).join(named, "x0").select(key, "group")


def density_clusters(df: DataFrame, key: str, coordinates: list[str], radius: float, least: int) -> DataFrame:
    """(key, cluster, core): density-based clusters. A row is core if ``least`` rows, itself counted, are within ``radius``; core rows within
    the radius of each other are one cluster, named by its least core key; another row within the radius of a core row joins the
    nearest one's cluster (ties to the least cluster); the rest are noise, their cluster null. Rows with a coordinate that is
    null or not finite are noise.

    A cell whose diagonal is the radius and that holds ``least`` rows has core rows only, so neighbours are counted for rows of emptier
    cells alone: a point of a full cell is compared with fewer than ``least`` points of each cell around it.
    """
    points, xs, cs = grid(df, key, coordinates, radius)
    points = kept_table(points)
    full = points.groupBy(*cs).agg((F.sum("n") >= least).alias("full"))
    points = kept_table(points.join(full, cs))
    moves, square = _around(len(xs)), radius * radius
    gap = sum(((F.col(f"q{i}") - F.col(x)) * (F.col(f"q{i}") - F.col(x)) for i, x in enumerate(xs)), F.lit(0.0))

    def around(some: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of a point of ``some`` (q0 ..) with the points of ``others`` within the radius."""
        asked = some.select(*(F.col(x).alias(f"q{i}") for i, x in enumerate(xs)), *cs)
        return _moved(asked, moves, cs).join(others, cs).withColumn("gap", gap).where(F.col("gap") <= square)

    q = [f"q{i}" for i in range(len(xs))]
    counted = around(points.where("not full"), points.select(*xs, *cs, "n")).groupBy(*q).agg((F.sum("n") >= least).alias("enough"))
    found = points.join(counted.select(*(F.col(f"q{i}").alias(x) for i, x in enumerate(xs)), "enough"), xs, "left")
    found = kept_table(found.withColumn("core", F.col("full") | F.coalesce("enough", F.lit(False))).drop("full", "enough"))
    core = found.where("core")
    core = kept_table(core.join(core.groupBy(*cs).agg(F.min("p").alias("cell")), cs))
    groups = connected(linked_cells(core, xs, cs, radius), core.select("cell"), "cell")
    core = core.join(groups, "cell").withColumnRenamed("group", "cluster")
    edge = around(found.where("not core"), core.select(*xs, *cs, "cluster")).groupBy(*q).agg(F.min(F.struct("gap", "cluster")).alias("best"))
    named = core.select(*xs, "cluster", F.lit(True).alias("core")).unionByName(edge.select(*(F.col(f"q{i}").alias(x) for i, x in enumerate(xs)), F.col("best.cluster").alias("cluster"), F.lit(False).alias("core")))
    rows = df.select(key, *(F.col(c).cast("double").alias(x) for x, c in zip(xs, coordinates, strict=True)))
    return rows.join(named, xs, "left").select(key, "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def fuzzy_pairs(keys: DataFrame, key: str, prefix: int, distance: int) -> DataFrame:
    """(a, b): distinct keys a < b of one prefix within a Levenshtein distance.

    A key is cut into distance + 1 segments by its length. Of two keys within the distance one segment of the one stands in the other,
    at most ``distance`` places off: so segments are joined with the substrings that they may be equal to, not keys with keys.
    """
    n = distance + 1
    rows = keys.select(F.col(key).alias("k"), F.length(key).alias("l"), F.substring(key, 1, prefix).alias("p"))
    cut = lambda i, length: F.floor(i * length / n).cast("int")
    nth = F.explode(F.sequence(F.lit(0), F.lit(distance)))
    own = rows.select("k", "l", "p", nth.alias("i"))
    own = own.select(F.col("k").alias("a"), "l", "p", "i", F.substring("k", cut(F.col("i"), F.col("l")) + 1, cut(F.col("i") + 1, F.col("l")) - cut(F.col("i"), F.col("l"))).alias("s"))
    other = rows.select("k", "p", F.col("l").alias("m"), nth.alias("i"))
    other = other.select("k", "p", "i", F.explode(F.sequence(F.greatest(F.col("m") - distance, F.lit(0)), F.col("m") + distance)).alias("l"))
    other = other.select("k", "p", "i", "l", F.explode(F.sequence(F.lit(-distance), F.lit(distance))).alias("off"))
    start = cut(F.col("i"), F.col("l")) + F.col("off")
    other = other.where(start >= 0).select(F.col("k").alias("b"), "p", "i", "l", F.substring("k", start + 1, cut(F.col("i") + 1, F.col("l")) - cut(F.col("i"), F.col("l"))).alias("s")).distinct()
    pairs = own.join(other, ["p", "i", "l", "s"]).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(F.levenshtein("a", "b") <= distance)


def fuzzy_groups(df: DataFrame, key: str, prefix: int = 3, distance: int = 1) -> DataFrame:
    """Distinct keys and the least key of their group: keys of one prefix within a Levenshtein distance are linked, transitively."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return connected(fuzzy_pairs(keys, key, prefix, distance), keys, key)


def sibling_fill(df: DataFrame, group: str, order: str, value: str, key: str) -> DataFrame:
    """``value`` filled, where null, by the last known of its group in order, else by that of the nearest earlier group that has
    one, else by the mean of all."""
    from .aggregates import _cuts, _part, parts_of

    known = df.groupBy(group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order, key))).alias("_last"))
    # groups are filled within ranges, then from the ranges before
    known = known.withColumn("_part", _part(group, _cuts(df, group, parts_of(df))))
    ends = known.where(F.col("_last").isNotNull()).groupBy("_part").agg(F.max_by("_last", group).alias("_end"))
    ends = known.select("_part").distinct().join(ends, "_part", "left")
    ends = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))  # a row for each part
    back = Window.partitionBy("_part").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_last", F.last("_last", ignorenulls=True).over(back)).join(F.broadcast(ends), "_part")
    known = known.select(group, F.coalesce("_last", "_carry").alias("_last"))
    overall = df.agg(F.avg(value).alias("_mean"))
    seen = Window.partitionBy(group).orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_own", F.last(value, ignorenulls=True).over(seen))
    return own.join(known, group, "left").crossJoin(overall).withColumn("filled", F.coalesce(value, "_own", "_last", "_mean")).drop("_own", "_last", "_mean")
