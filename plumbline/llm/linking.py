"""From signature bands to classes: candidates by shared bands, exact verification, connected components.

Rows are identified by a key of their content, so copies are one row. Two rows that share a bucket end in one class, or have
been compared. Each member of a bucket is compared with the bucket's least and greatest key and, if it joins neither's
class, with a few drawn members; that brings most of a bucket into one class. Where several classes are left, all pairs of
unlike classes are compared: one by one in small buckets, else block by block, where only the links found are emitted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of the bitmaps that spare rows without candidates the shuffle; a full bitmap spares none and loses none.
BITMAP, PAGE = 1 << 26, 1 << 15
#: Members up to which a bucket's pairs of unlike classes are emitted one by one, and further members of a bucket, drawn by hashes, that a
#: row is compared with first if it joined the class of neither end.
FEW, DRAWN = 8, 8
#: About so many rows, or elements of their sets, make a block; shingles that are looked at together.
BLOCK_ROWS, BLOCK_ELEMENTS, WIDE = 1024, 500_000, 1024


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(key, class): the least key of each connected component of ``links`` (a, b). Labels spread along links and jump to
    their label's label, so the number of rounds grows with the logarithm of a component's breadth."""
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "key"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("class").alias("near"))
        low = labels.join(near, labels["key"] == near["a"]).select("key", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        top = labels.select(F.col("key").alias("class"), F.col("class").alias("top"))
        fresh = scratch.keep(low.join(top, "class").select("key", "old", F.least("class", "top").alias("class")), "labels")
        done = fresh.where(F.col("class") != F.col("old")).isEmpty()
        scratch.drop(labels)
        labels = fresh.drop("old")
        labels._scratch_path = fresh._scratch_path
        if done:
            scratch.drop(both)
            return labels


def _bitmap(spots: DataFrame) -> Broadcast:
    """A bit for each of the ``spot``s (from 1 to BITMAP) of a table, BITMAP bits whatever its size. Spots are shuffled, not pages of them."""
    dealt = spots.select(F.bitmap_bucket_number("spot").alias("page"), F.bitmap_bit_position("spot").alias("bit")).repartition("page")
    pages = dealt.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(BITMAP // 8, np.uint8)
    for p in pages:
        bits[(p["page"] - 1) * PAGE // 8 : p["page"] * PAGE // 8] = np.frombuffer(bytes(p["bits"]), np.uint8)
    return spots.sparkSession.sparkContext.broadcast(bits)


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _spot(of: Column) -> Column:
    return F.pmod(of, F.lit(BITMAP)) + 1


def _texts_of(edges: DataFrame, contents: DataFrame) -> DataFrame:
    """(key, text) of the keys that edges name: a bitmap of bounded size drops most other rows, copies become one row, then
    an exact join follows."""
    keys = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
    held = _bitmap(keys.select(_spot(F.xxhash64("key")).alias("spot")))
    maybe = F.arrow_udf(lambda at: pa.array(_held(held.value, at.to_numpy() - 1)), "boolean")
    return contents.where(maybe(_spot(F.xxhash64("key")))).groupBy("key").agg(F.min("text").alias("text")).join(keys, "key", "left_semi")


def _members(scratch: Scratch, bands: DataFrame) -> DataFrame:
    """(bucket, key) of distinct keys in buckets that several rows share; few other rows are left.

    Buckets are counted by their hashes alone; a bitmap of bounded size of those that several rows share then spares the rest
    the shuffle of their keys.
    """
    busy = bands.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = _bitmap(busy.select(_spot(F.col("bucket")).alias("spot")))

    def shared(bands: pa.Array) -> pa.Array:
        flat, sizes = pc.list_flatten(bands).to_numpy(), pc.fill_null(pc.list_value_length(bands), 0).to_numpy()
        keep = _held(held.value, flat % BITMAP)
        ends = np.cumsum(np.concatenate([[0], keep]))[np.cumsum(np.concatenate([[0], sizes]))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[keep]))

    # a deterministic function's filter is pushed below it, so that each task runs the function twice, in two workers at once
    once = F.arrow_udf(shared, "array<bigint>").asNondeterministic()
    some = bands.select("key", once(F.col("bands")).alias("bands")).where(F.size("bands") > 0)
    few = scratch.keep(some.groupBy("key").agg(F.first("bands").alias("bands")), "few")
    return few.select("key", F.explode("bands").alias("bucket"))


def arrays(lists: pa.Array) -> list[np.ndarray]:
    """An Arrow array of lists of longs as views."""
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy()]))
    flat = pc.list_flatten(lists).to_numpy()
    return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def link(
    bands: DataFrame,
    contents: DataFrame,
    unpack: Callable[[pa.Array], pa.Array],
    similarity: Callable[[np.ndarray, np.ndarray], float],
    threshold: float,
) -> DataFrame:
    """(key, class) of every key that has a link; the class is the least key of its component.

    ``bands``: (key, bands array<long>), equal for equal keys. ``contents``: (key, text), from which ``unpack`` makes the
    array<long> that ``similarity`` compares; only rows with candidates are shuffled or unpacked. Of the tables that this writes to
    the shared folder, the result alone is left.
    """
    scratch = Scratch(bands.sparkSession, "links")
    measure = F.arrow_udf(lambda x, y: pa.array([similarity(a, b) for a, b in zip(arrays(x), arrays(y), strict=True)], pa.float64()), "double")
    members = _members(scratch, bands)
    # kept, so that the joins that follow are of plain shuffles, whose hot buckets Spark can split
    busy = scratch.keep(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n > 1"), "busy")
    active = scratch.keep(members.join(busy, "bucket").select("bucket", "key", "lo", "hi"), "active")
    pairs = scratch.keep(_ends(active), "pairs")
    # all later rounds' keys are in a pair of the first
    sets = scratch.keep(_texts_of(pairs, contents).select("key", F.arrow_udf(unpack, "array<bigint>")(F.col("text")).alias("set")), "sets")

    def verified(p: DataFrame) -> DataFrame:
        left = sets.select(F.col("key").alias("a"), F.col("set").alias("x"))
        right = sets.select(F.col("key").alias("b"), F.col("set").alias("y"))
        return scratch.keep(p.join(left, "a").join(right, "b").where(measure("x", "y") >= threshold).select("a", "b"), "links")

    # each row's likeliest partner first; then what still lies between classes, of the other ends and of members drawn
    best = F.expr("row_number() over (partition by b order by shared desc, a)")
    firsts = scratch.keep(pairs.withColumn("r", best).where("r = 1").select("a", "b"), "firsts")
    classes = components(scratch, verified(firsts))
    drawn = _drawn(scratch, active, _unresolved(active, classes))
    done = scratch.keep(pairs.select("a", "b").unionByName(drawn).distinct(), "pairs")
    found = verified(_between(done.join(firsts, ["a", "b"], "left_anti"), classes))
    if not found.isEmpty():
        classes = _merged(scratch, classes, found)
    mixed = _mixed(scratch, active, classes)
    some = verified(_few(mixed.where(F.col("n") <= FEW)).distinct().join(done, ["a", "b"], "left_anti"))
    many = _by_blocks(scratch, mixed.where(F.col("n") > FEW), sets, similarity, threshold)
    found = some.unionByName(many)
    return scratch.only(classes if found.isEmpty() else _merged(scratch, classes, found))


def _unresolved(active: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``active`` with their class, that are in the class of neither end of their bucket."""
    own = active.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    ends = [classes.select(F.col("key").alias(e), F.col("class").alias(f"c_{e}")) for e in ("lo", "hi")]
    own = own.where("key != lo and key != hi").join(ends[0], "lo", "left").join(ends[1], "hi", "left")
    return own.where((F.col("class") != F.coalesce("c_lo", "lo")) & (F.col("class") != F.coalesce("c_hi", "hi")))


def _drawn(scratch: Scratch, active: DataFrame, left: DataFrame) -> DataFrame:
    """(a, b): unresolved rows with DRAWN members of their bucket, each the least by another hash."""
    left = scratch.keep(left.select("bucket", "key"), "left")
    some = active.join(scratch.keep(left.select("bucket").distinct(), "buckets"), "bucket", "left_semi")
    ends = scratch.keep(some.groupBy("bucket").agg(*(F.min_by("key", F.xxhash64(F.lit(i), "key")).alias(f"e{i}") for i in range(DRAWN))), "drawn")
    far = left.select("bucket", "key").join(ends, "bucket").select("key", F.explode(F.array_distinct(F.array(*(f"e{i}" for i in range(DRAWN))))).alias("end")).where("key != end")
    return far.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()


def _ends(active: DataFrame) -> DataFrame:
    """(a, b, shared): each member with the least and greatest key of its bucket, and how many buckets say so."""
    ends = active.select("key", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("end")).where("key != end")
    return ends.groupBy(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).agg(F.count("*").alias("shared"))


def _few(active: DataFrame) -> DataFrame:
    """(a, b): pairs of unlike classes in buckets of at most FEW members."""
    lists = active.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "class"))).alias("m"))  # at most FEW each
    a = lists.select("m", F.posexplode("m").alias("i", "x"))
    p = a.select("x", F.explode(F.slice("m", F.col("i") + 2, FEW)).alias("y")).where("x.class != y.class")
    return p.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def _merged(scratch: Scratch, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after further links. These are first brought down to distinct pairs of classes, so that what spreads labels is small."""
    ca = classes.select(F.col("key").alias("a"), F.col("class").alias("ca"))
    cb = classes.select(F.col("key").alias("b"), F.col("class").alias("cb"))
    pairs = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(scratch, pairs.where("a != b").distinct()).select(F.col("key").alias("class"), F.col("class").alias("top"))
    old = classes.join(top, "class", "left").select("key", F.coalesce("top", "class").alias("class"))
    new = top.join(classes.select(F.col("key").alias("class")), "class", "left_anti").select(F.col("class").alias("key"), F.col("top").alias("class"))
    return scratch.keep(old.unionByName(new), "classes")


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    ca = classes.select(F.col("key").alias("a"), F.col("class").alias("ca"))
    cb = classes.select(F.col("key").alias("b"), F.col("class").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(scratch: Scratch, active: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, key, class, n, main): members of the buckets that hold several classes; ``main`` is the class of most of them."""
    own = active.select("bucket", "key").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    own = scratch.keep(own, "own")
    parts = own.groupBy("bucket", "class").agg(F.count("*").alias("m"))
    kinds = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "class"))["class"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    return scratch.keep(own.join(scratch.keep(kinds.drop("kinds"), "kinds"), "bucket"), "mixed")


def _by_blocks(scratch: Scratch, mixed: DataFrame, sets: DataFrame, similarity: Callable[[np.ndarray, np.ndarray], float], threshold: float) -> DataFrame:
    """(a, b): links that join all linked rows of unlike classes of each bucket.

    A bucket's main class and the rest are dealt to blocks; a block of the rest meets itself and all other blocks, one of the
    main class those of the rest only. A group is one pair of blocks.
    """
    rows = mixed.join(sets.select("key", F.size("set").alias("size")), "key").withColumn("of_main", F.expr("class = main"))
    count = lambda side: F.ceil(F.greatest(F.sum(F.when(side, 1)) / BLOCK_ROWS, F.sum(F.when(side, F.col("size"))) / BLOCK_ELEMENTS)).cast("int")
    blocks = rows.groupBy("bucket").agg(count(~F.col("of_main")).alias("h"), count(F.col("of_main")).alias("g"))
    spot = F.when(F.col("of_main"), F.expr("h + cast(pmod(xxhash64(key), g) as int)")).otherwise(F.expr("cast(pmod(xxhash64(key), h) as int)"))
    before = "transform(sequence(0, least(spot, h - 1)), x -> struct(x as i, spot as j))"
    after = "if(spot < h, transform(sequence(spot + 1, h + g - 1), x -> struct(spot as i, x as j)), array())"
    dealt = rows.join(blocks, "bucket").withColumn("spot", spot).select("bucket", "key", "class", "spot", F.explode(F.expr(f"concat({before}, {after})")).alias("pair"))
    dealt = dealt.join(sets, "key").select("bucket", "pair.i", "pair.j", "spot", "key", "class", "set")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["spot"] == group[x].iloc[0]] for x in ("i", "j"))
        return pd.DataFrame(_links_of(left, right, similarity, threshold), columns=["a", "b"])

    return scratch.keep(dealt.groupBy("bucket", "i", "j").applyInPandas(run, "a binary, b binary"), "links")


def _bounds(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs, plain Jaccard of the distinct elements, and a bound of any weighted one.

    With weights 1 + ln of the counts that sum to 1, the chance of a common draw is at most each side's weight of what both hold.
    If neither side's elements repeat, the bound is the plain value.
    """
    held = []
    for rows in (left, right):
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        flat = np.concatenate(rows)
        order = np.lexsort((flat, row))
        row, flat = row[order], flat[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])]))
        weight = 1 + np.log(np.diff(np.append(new, len(flat))))
        row, flat = row[new], flat[new]
        total = np.bincount(row, weight, len(rows))
        held.append((row, flat, (weight / total[row]).astype(np.float32), np.bincount(row, minlength=len(rows)), np.bincount(row, weight > 1, len(rows)) > 0))
    (ra, fa, wa, na, da), (rb, fb, wb, nb, db) = held
    both = np.intersect1d(fa, fb)
    keep_a, keep_b = np.isin(fa, both), np.isin(fb, both)
    ra, fa, wa, rb, fb, wb = ra[keep_a], np.searchsorted(both, fa[keep_a]), wa[keep_a], rb[keep_b], np.searchsorted(both, fb[keep_b]), wb[keep_b]
    common, mass_a, mass_b = (np.zeros((len(left), len(right)), np.float32) for _ in range(3))
    repeats = da.any() or db.any()
    oa, ob = np.argsort(fa, kind="stable"), np.argsort(fb, kind="stable")
    ra, fa, wa, rb, fb, wb = ra[oa], fa[oa], wa[oa], rb[ob], fb[ob], wb[ob]
    for start in range(0, len(both), WIDE):
        width = min(WIDE, len(both) - start)
        (a0, a1), (b0, b1) = np.searchsorted(fa, [start, start + width]), np.searchsorted(fb, [start, start + width])
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ra[a0:a1], fa[a0:a1] - start] = 1
        y[rb[b0:b1], fb[b0:b1] - start] = 1
        common += x @ y.T
        if repeats:
            p, q = np.zeros_like(x), np.zeros_like(y)
            p[ra[a0:a1], fa[a0:a1] - start] = wa[a0:a1]
            q[rb[b0:b1], fb[b0:b1] - start] = wb[b0:b1]
            mass_a += p @ y.T
            mass_b += x @ q.T
    plain = common / (na[:, None] + nb[None, :] - common)
    bound = np.where(da[:, None] | db[None, :], np.minimum(mass_a, mass_b), plain) if repeats else plain
    return plain, bound


def _links_of(left: pd.DataFrame, right: pd.DataFrame, similarity: Callable[[np.ndarray, np.ndarray], float], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between rows (key, class, set) of unlike classes, of which none follows from the others."""
    ka, kb, sa, sb = left["key"].tolist(), right["key"].tolist(), left["set"].tolist(), right["set"].tolist()
    kinds, of = np.unique(np.array([bytes(c).hex() for c in [*left["class"], *right["class"]]]), return_inverse=True)
    ca, cb, up = of[: len(ka)], of[len(ka) :], list(range(len(kinds)))

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    plain, bound = _bounds(sa, sb)
    apart, out = ca[:, None] != cb[None, :], []
    likely, open_ = plain >= threshold - 1e-5, apart & (bound >= threshold - 1e-5)  # rounding is left to the exact measure
    for some in (likely & open_, ~likely & open_):
        for i, j in zip(*(x.tolist() for x in np.nonzero(some)), strict=True):
            x, y = top(int(ca[i])), top(int(cb[j]))
            if x != y and similarity(np.asarray(sa[i]), np.asarray(sb[j])) >= threshold:
                up[y] = x
                out.append((min(ka[i], kb[j]), max(ka[i], kb[j])))
    return out
