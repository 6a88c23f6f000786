"""Secret scans with a trigram inverted index, in DataFrame functions only.

For each rule's regex a Boolean trigram query is derived on the driver: every text that matches must satisfy
it. The index holds posting lists (trigram, text key) of the trigrams that the queries name. A query's lists are
intersected by key: a key meets a conjunction if it stands in all of its lists, and a query if it meets an option of each
clause. These candidates alone are verified with the rule's regex. A rule whose regex has no mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, local_table

#: Expansions of a stretch of a regex that are followed before its trigrams are taken.
MOST = 64
#: Bits of the bitmap that spares other rows than candidates the shuffle (a full one spares none and loses none); matches of a run.
BITMAP, RUN = 1 << 24, 512
SPANS = "array<struct<start:int,nth:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java's and Python's regex engines and never match nothing. Matches whose ``group``
    is shorter than ``least`` characters are found (later ones can't overlap them) and then dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the contract's base rules; the rest are public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)


def trigram_queries(pattern: str) -> list[list[list[str]]]:
    """The conjunction (outer list) of disjunctions (middle) of conjunctions (inner) of mandatory trigrams.

    The regex is walked from left to right with the set of strings that the last stretch can stand for. Literals,
    small classes, alternations and optional parts multiply the set; anything else ends the stretch, and the
    strings' trigrams become one disjunction, if all strings have at least three characters.
    """
    out: list[list[list[str]]] = []

    def close(strings: set[str] | None) -> None:
        if strings and min(map(len, strings)) >= 3:
            either = sorted({tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in strings})
            either = [list(a) for a in either if not any(set(b) < set(a) for b in either)]
            if either not in out:
                out.append(either)

    def expand(nodes) -> set[str] | None:
        """All strings that the nodes can stand for, or None."""
        got = {""}
        for n in nodes:
            more = one(n)
            if more is None or len(got) * len(more) > MOST:
                return None
            got = {a + b for a in got for b in more}
        return got

    def one(node) -> set[str] | None:
        op, arg = node
        if op is rc.LITERAL:
            return {chr(arg).lower()}
        if op is rc.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is rc.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is rc.RANGE and x[1] - x[0] < 8:
                    chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    return None
            return chars
        if op is rc.SUBPATTERN:
            return expand(arg[3])
        if op is rc.BRANCH:
            parts = [expand(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is rc.MAX_REPEAT and arg[1] <= 8:
            part, total = expand(arg[2]), set()
            for n in range(arg[0], arg[1] + 1):
                run = expand(list(arg[2]) * n)
                if part is None or run is None:
                    return None
                total |= run
            return total
        return None

    stretch: set[str] | None = {""}
    for node in _parser.parse(pattern):
        more = one(node)
        if more is None or len(stretch) * len(more) > MOST:
            close(stretch)
            stretch = {""} if more is None else more
        else:
            stretch = {a + b for a in stretch for b in more}
    close(stretch)
    return out


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """array<struct<start, nth, end, kind>> of a rule's matches, in code points: the texts between matches give the offsets.

    Runs of RUN matches are placed within themselves, then set off by the runs before them, so that long lists aren't copied
    for each match.
    """
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    key = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    none = F.expr(f"cast(array() as {SPANS})")

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(at).alias("nth"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("pos"), F.when(F.length(x["key"]) >= rule.least, F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"]).alias("out"))

    def set_off(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: span(acc["pos"] + s["start"], acc["pos"] + s["end"]))
        return F.struct((acc["pos"] + x["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), key.alias("key"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(RUN))
    runs = F.transform(starts, lambda i: F.aggregate(F.slice(rows, i, RUN), F.struct(F.lit(0).alias("pos"), none.alias("out")), step))
    nested = F.expr(f"cast(array() as array<{SPANS}>)")
    placed = F.aggregate(runs, F.struct(F.lit(0).alias("pos"), nested.alias("out")), set_off, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(rule.pattern), placed).otherwise(none)


def _postings(docs: DataFrame, named: list[str]) -> DataFrame:
    """The inverted index: (trigram, as its place in ``named``; _scan_key) without repetition. Texts are put in lower case once."""
    low = docs.where("text is not null").select("_scan_key", F.lower("text").alias("_scan_low"))
    held = F.filter(F.array(*(F.when(F.contains("_scan_low", F.lit(t)), F.lit(i)) for i, t in enumerate(named))), lambda i: i.isNotNull())
    return low.select("_scan_key", F.explode(held).alias("trigram")).distinct()


def _candidates(postings: DataFrame, queries: list[list[list[list[str]]]], named: list[str]) -> DataFrame:
    """(_scan_key, _scan_kinds): the rules whose queries a key meets, from the intersections of their posting lists."""
    spark, at = postings.sparkSession, {t: i for i, t in enumerate(named)}
    terms = [(at[t], r, c, o, len(every)) for r, q in enumerate(queries) for c, either in enumerate(q) for o, every in enumerate(either) for t in every]
    terms = F.broadcast(local_table(spark, terms, "trigram int, rule int, clause int, option int, need int"))  # the rules' trigrams
    sizes = F.create_map(*(F.lit(x) for r, q in enumerate(queries) if q for x in (r, len(q))))
    lists = postings.repartition("_scan_key").join(terms, "trigram")  # all that follows is by key
    met = lists.groupBy("_scan_key", "rule", "clause", "option").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    met = met.groupBy("_scan_key", "rule").agg(F.count_distinct("clause").alias("n")).where(F.col("n") == sizes[F.col("rule")])
    return met.groupBy("_scan_key").agg(F.collect_set("rule").alias("_scan_kinds"))


def _may_hold(key: Column, bits: Column) -> Column:
    """Whether a page's bit for a key is set; without a page it isn't."""
    place = F.bitmap_bit_position(_spot(key))
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def _spot(key: Column) -> Column:
    return F.pmod(key, F.lit(BITMAP)) + 1


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with a column secret_spans: array<struct<start, nth, end, kind>>, by start, then rule.

    Spans are leftmost, non-overlapping for each rule, in code points, the end exclusive. A null text has no
    spans. Null ids, repeated rows and other columns change nothing (a clashing secret_spans is replaced).
    Equal texts share a key, so copies share postings; a collision of keys only adds a candidate, which the
    regex then rejects. Only posting lists of the queries' trigrams are built. Candidates' texts meet their rules by a
    join; a bitmap of bounded size tells most others, which stay where they are.
    """
    scratch = Scratch(documents.sparkSession, "secrets")
    queries = [trigram_queries(r.pattern) for r in rules]
    named = sorted({t for q in queries for either in q for every in either for t in every})
    keep = [c for c in documents.columns if c not in ("secret_spans", "_scan_key", "_scan_kinds", "_scan_page", "_scan_bits", "_scan_at")]
    docs = documents.select(*keep).withColumn("_scan_key", F.xxhash64("text"))
    none = F.expr(f"cast(array() as {SPANS})")

    def found(rows: DataFrame, kinds: Column | None) -> DataFrame:
        spans = [_spans(F.col("text"), r, i) for i, r in enumerate(rules)]
        if kinds is not None:
            spans = [F.when(F.array_contains(kinds, i), s) if queries[i] else s for i, s in enumerate(spans)]
        else:
            spans = [s for i, s in enumerate(spans) if not queries[i]]
        return rows.select(*keep, F.array_sort(F.concat(none, *(F.coalesce(s, none) for s in spans))).alias("secret_spans"))

    if not named:
        return found(docs, None)
    postings = scratch.keep(_postings(docs, named), "postings")
    candidates = scratch.keep(_candidates(postings, queries, named), "candidates")
    page, bit = F.bitmap_bucket_number(_spot(F.col("_scan_key"))), F.bitmap_bit_position(_spot(F.col("_scan_key")))
    spots = candidates.select(page.alias("_scan_page"), bit.alias("bit")).repartition("_scan_page")  # spots are shuffled, not pages of them
    pages = scratch.keep(spots.groupBy("_scan_page").agg(F.bitmap_construct_agg("bit").alias("_scan_bits")), "pages")
    docs = docs.withColumn("_scan_at", page).join(F.broadcast(pages), F.col("_scan_at") == F.col("_scan_page"), "left")  # BITMAP / 8 bytes at most
    maybe = F.col("text").isNotNull() & _may_hold(F.col("_scan_key"), F.col("_scan_bits"))
    near = docs.where(maybe).drop("_scan_page", "_scan_bits", "_scan_at").join(candidates, "_scan_key", "left")
    return found(near, F.coalesce("_scan_kinds", F.array().cast("array<int>"))).unionByName(found(docs.where(~maybe), None))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base rules' spans) and spans (all), as kind:start:end."""
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["nth"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["nth"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans")
    )


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``scanned`` with every span's characters replaced by ``mark`` in text (overlapping spans by one), without secret_spans."""
    empty = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        between = F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text")))
    clean = F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", empty, step, rest)).otherwise(F.col("text"))
    return scanned.withColumn("text", clean).drop("secret_spans")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """The rules' spans by plain search, for tests: (start, index of the rule, end) in order."""
    out = []
    for i, r in enumerate(RULES):
        out += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)
