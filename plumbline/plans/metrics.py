"""Queries over metrics. Predictions are derived from the tables: for labels, a function of n_chars; for prices, of quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dominance
from ..operators import metrics as M
from .registry import query

S = "(SELECT d.doc_id, d.lang, l.quality AS y, l.toxic AS t, (d.n_chars % 97) / 97.0 AS p, (d.n_chars % 89) / 89.0 AS p2 FROM documents d JOIN labels l USING (doc_id))"
R = "(SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey, l_extendedprice AS y, l_quantity * 1500.0 AS p, 38000.0 AS b FROM lineitem)"


def scored(read):
    d, lab = read("documents").select("doc_id", "lang", "n_chars"), read("labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), F.col("toxic").alias("t"), ((F.col("n_chars") % 97) / 97.0).alias("p"), ((F.col("n_chars") % 89) / 89.0).alias("p2"))


def priced(read):
    return read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"), F.lit(38000.0).alias("b"))


@query(
    f"""WITH s AS {S}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS r,
          sum(y) OVER (PARTITION BY lang ORDER BY p DESC) / count(*) OVER (PARTITION BY lang ORDER BY p DESC) AS pr FROM s),
        a AS (SELECT lang, sum(y) AS np, count(*) - sum(y) AS nn, sum(r) FILTER (y = 1) AS rs, sum(pr) FILTER (y = 1) AS ap FROM r GROUP BY 1)
        SELECT lang, CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2) / (np * nn) END AS roc_auc, CASE WHEN np > 0 AND nn > 0 THEN ap / np END AS pr_auc FROM a""",
    "roc_auc pr_auc",
)
def auc_per_group(read):
    return M.auc(scored(read), "y", "p", ["lang"])


@query(
    f"""SELECT lang, avg((p - y) * (p - y)) AS brier, CASE WHEN min(y) <> max(y) THEN -avg(CASE WHEN y = 1 THEN ln(least(greatest(p, {M.EPS}), 1 - {M.EPS})) ELSE ln(1 - least(greatest(p, {M.EPS}), 1 - {M.EPS})) END) END AS log_loss,
        avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0) AS separation FROM {S} GROUP BY 1""",
    "brier log_loss separation",
)
def logloss_brier(read):
    return M.probability_scores(scored(read), "y", "p", ["lang"])


@query(
    f"""WITH s AS {S}, i AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM s),
        b AS (SELECT y, (i >= (n * 1) // 5)::INT + (i >= (n * 2) // 5)::INT + (i >= (n * 3) // 5)::INT + (i >= (n * 4) // 5)::INT AS bin FROM i),
        t AS (SELECT bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM b GROUP BY 1), g AS (SELECT *, sum(positives) OVER (ORDER BY bin) / sum(positives) OVER () AS gain FROM t)
        SELECT *, gain / (sum(n) OVER (ORDER BY bin) / sum(n) OVER ()) AS lift FROM g""",
    "gain lift",
)
def gains_table(read):
    return M.gains_table(scored(read), "y", "p", "doc_id", 5)


@query(
    f"""WITH s AS {S}, i AS (SELECT y, p, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM s), g AS (SELECT *, CAST(greatest(floor((i - n % 10) / (n // 10)), 0) AS BIGINT) AS g FROM i),
        t AS (SELECT g, count(*) AS n, sum(y) AS o, sum(p) AS e FROM g GROUP BY 1) SELECT sum((o - e) * (o - e) / (e * (1 - e / n))) AS statistic, greatest(1, count(*) - 2) AS dof FROM t""",
    "statistic",
)
def hosmer_lemeshow(read):
    return M.hosmer_lemeshow(scored(read), "y", "p", "doc_id")


@query(
    f"""WITH s AS {S}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s)
        SELECT 2 * (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) - 1 AS accuracy_ratio FROM r""",
    "accuracy_ratio",
)
def accuracy_ratio(read):
    return M.accuracy_ratio(scored(read), "y", "p")


@query(
    f"""WITH s AS {S}, n AS (SELECT p, sum(y) AS a, count(*) AS n FROM s GROUP BY 1), c AS (SELECT p AS threshold, sum(a) OVER (ORDER BY p DESC) AS tp, sum(n - a) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS P, sum(n - a) OVER () AS N FROM n),
        v AS (SELECT threshold, tp / P + (N - fp) / N - 1 AS value FROM c UNION ALL SELECT NULL, 0) SELECT threshold, value FROM v ORDER BY value DESC, threshold DESC NULLS FIRST LIMIT 1""",
    "threshold value",
)
def best_threshold(read):
    return M.best_threshold(scored(read), "y", "p", "youden")


@query(
    f"""WITH s AS (SELECT CAST(floor(p * 4) AS INTEGER) AS i, CAST(floor(p2 * 4) AS INTEGER) AS j FROM {S}), n AS (SELECT i, j, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT i, sum(n) AS ni FROM n GROUP BY 1), b AS (SELECT j, sum(n) AS nj FROM n GROUP BY 1)
        SELECT 1 - (SELECT sum(pow(i - j, 2) * n) * sum(n) FROM n) / (SELECT sum(pow(i - j, 2) * ni * nj) FROM a, b) AS kappa""",
    "kappa",
)
def quadratic_kappa(read):
    return M.weighted_kappa(scored(read).select(F.floor(F.col("p") * 4).alias("i"), F.floor(F.col("p2") * 4).alias("j")), "i", "j")


@query(f"SELECT y, CAST(count(*) FILTER (p < 0.5) AS BIGINT) AS pred_0, CAST(count(*) FILTER (p >= 0.5) AS BIGINT) AS pred_1 FROM {S} GROUP BY 1")
def confusion_matrix(read):
    return M.confusion(scored(read).withColumn("c", (F.col("p") >= 0.5).cast("int")), "y", "c", [0, 1])


@query(f"SELECT code, count(*) AS n FROM (SELECT (p >= 0.25)::INT + (p >= 0.5)::INT + (p >= 0.75)::INT AS code FROM {S}) GROUP BY 1")
def ordinal_cutpoints(read):
    return M.ordinal_codes(scored(read), "p", [0.25, 0.5, 0.75]).groupBy("code").agg(F.count("*").alias("n"))


@query(
    f"""SELECT avg((abs(p - y) <= 5000)::INT) AS within, avg(abs(p - y)) / avg(abs(b - y)) AS rel_mae, avg(abs(p - y) / nullif(abs(b - y), 0)) AS mrae, avg((abs(p - y) < abs(b - y))::INT) AS better,
        avg(abs(p - y) + ln(1 + exp(-2 * abs(p - y))) - ln(2.0)) AS log_cosh, sqrt(avg((p - y) * (p - y))) AS rmse, sqrt(avg(pow((p - y) / nullif(y, 0), 2))) AS rmspe, sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))) AS rmsle FROM {R}""",
    "within rel_mae mrae better log_cosh rmse rmspe rmsle",
)
def regression_scores(read):
    return M.regression_scores(priced(read), "y", "p", "b", 5000.0)


@query(
    f"""SELECT avg(2 * (y * ln(y / p) - y + p)) AS poisson, avg(2 * (-ln(y / p) + (y - p) / p)) AS gamma, avg(2 * (pow(y, 0.5) / (-0.25) - y * pow(p, -0.5) / (-0.5) + pow(p, 0.5) / 0.5)) AS tweedie FROM {R}""",
    "poisson gamma tweedie",
)
def deviances(read):
    return M.deviances(priced(read), "y", "p")


@query(
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY y) + (count(*) OVER (PARTITION BY l_suppkey, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY l_suppkey ORDER BY p) + (count(*) OVER (PARTITION BY l_suppkey, p) - 1) / 2 AS rp FROM {R})
        SELECT l_suppkey, corr(p, y) AS pearson, corr(rp, ry) AS spearman FROM r GROUP BY 1""",
    "pearson spearman",
)
def correlations(read):
    return M.correlations(priced(read), "p", "y", ["l_suppkey"])


@query(
    f"""WITH s AS (SELECT lang, CAST(floor(p * 5) AS INTEGER) AS y, floor(p2 * 10) AS p FROM {S}), j AS (SELECT a.lang, sign(a.y - b.y) AS dy, sign(a.p - b.p) AS dp FROM s a JOIN s b ON a.lang = b.lang)
        SELECT lang, sum(dy * dp) / sqrt(sum(abs(dy)) * sum(abs(dp))) AS tau_b, avg(CASE WHEN dp = dy THEN 1 WHEN dp = 0 THEN 0.5 ELSE 0 END) FILTER (dy <> 0) AS c_index FROM j GROUP BY 1""",
    "tau_b c_index",
)
def kendall_c_index(read):
    s = scored(read).select("doc_id", "lang", F.floor(F.col("p") * 5).alias("y"), F.floor(F.col("p2") * 10).alias("p"))
    return dominance.pair_concordance(s, "lang", "y", "p")


_Z = 1.959963984540054


@query(
    f"""WITH a AS (SELECT o_orderpriority, count(*) AS n, sum((o_orderstatus = 'F')::INT) / count(*) AS q FROM orders GROUP BY 1)
        SELECT o_orderpriority, (q + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} / (1 + {_Z * _Z} / n) * sqrt(q * (1 - q) / n + {_Z * _Z} / (4.0 * n * n)) AS low,
          (q + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} / (1 + {_Z * _Z} / n) * sqrt(q * (1 - q) / n + {_Z * _Z} / (4.0 * n * n)) AS high FROM a""",
    "low high",
)
def wilson_interval(read):
    a = read("orders").groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("s"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("s"), F.col("n"))
    return a.select("o_orderpriority", lo.alias("low"), hi.alias("high"))


@query(
    f"""SELECT c AS cut, (sum((p >= c AND y = 1)::INT) - sum((p >= c AND y = 0)::INT) * c / (1 - c)) / count(*) AS net_benefit, avg(y) - (1 - avg(y)) * c / (1 - c) AS treat_all
        FROM {S}, (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7]) AS c) GROUP BY c""",
    "net_benefit treat_all",
)
def decision_curve(read):
    return M.decision_curve(scored(read), "y", "p", [0.1, 0.3, 0.5, 0.7])


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM {S} GROUP BY 1", "mean_p rate")
def reliability_bins(read):
    return M.reliability(scored(read), "y", "p")


@query(
    f"""WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM {S} GROUP BY 1), a AS (SELECT count(*) AS a, avg(y) AS base FROM {S})
        SELECT sum(n / a * abs(m - r)) AS ece, sqrt(greatest(sum(n / a * ((m - r) * (m - r) - r * (1 - r) / greatest(n - 1, 1))), 0)) AS ece_debiased, sum(n / a * (m - r) * (m - r)) AS rel,
          sum(n / a * (r - base) * (r - base)) AS res, any_value(base * (1 - base)) AS unc FROM b, a""",
    "ece ece_debiased rel res unc",
)
def ece_bins(read):
    return M.calibration(scored(read), "y", "p")


@query(
    f"""WITH s AS (SELECT lang AS q, doc_id, p AS s, y + t * 2 AS rel FROM {S}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS i, row_number() OVER (PARTITION BY q ORDER BY rel DESC, doc_id) AS b FROM s),
        h AS (SELECT *, (rel > 0)::INT AS hit, sum((rel > 0)::INT) OVER (PARTITION BY q ORDER BY i) AS hits, (pow(2, rel) - 1) / 16 AS stop,
          exp(coalesce(sum(ln(1 - (pow(2, rel) - 1) / 16)) OVER (PARTITION BY q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS go FROM r)
        SELECT q, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 10) AS dcg, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 10) / nullif(sum((pow(2, rel) - 1) / log2(b + 1)) FILTER (b <= 10), 0) AS ndcg, coalesce(sum(hits / i) FILTER (i <= 10 AND hit = 1), 0) / nullif(least(10, sum(hit)), 0) AS map,
          coalesce(1 / min(i) FILTER (hit = 1), 0) AS mrr, sum(hit) FILTER (i <= 10) / least(10, count(*)) AS precision, max(hit) FILTER (i <= 10) AS hit, sum(go * stop / i) FILTER (i <= 10) AS err FROM h GROUP BY 1""",
    "dcg ndcg map mrr precision err",
)
def ndcg_map_mrr(read):
    s = scored(read).select(F.col("lang").alias("q"), "doc_id", F.col("p").alias("s"), (F.col("y") + F.col("t") * 2).alias("rel"))
    return M.ranking_scores(s, "q", "s", "rel", "doc_id", 10)


_A, _B = "SELECT o_totalprice AS v FROM orders WHERE o_orderdate < '1999-01-01'", "SELECT o_totalprice AS v FROM orders WHERE o_orderdate >= '1999-01-01'"


def _two(read):
    o = read("orders")
    return o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'")


@query(
    f"""WITH a AS ({_A}), b AS ({_B}), e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM a),
        na AS (SELECT len(list_filter(e, lambda x: v >= x)) AS bin, count(*) / (SELECT count(*) FROM a) AS p FROM a, e GROUP BY 1), nb AS (SELECT len(list_filter(e, lambda x: v >= x)) AS bin, count(*) / (SELECT count(*) FROM b) AS q FROM b, e GROUP BY 1),
        t AS (SELECT greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q FROM na FULL JOIN nb USING (bin))
        SELECT sum((q - p) * ln(q / p)) AS psi, sum(q * ln(q / p)) AS kl, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js FROM t""",
    "psi kl js",
    9,
)
def psi_kl_js(read):
    return M.distribution_drift(*_two(read), "o_totalprice")


@query(
    f"""WITH u AS (SELECT v, 1 AS a, 0 AS b FROM ({_A}) UNION ALL SELECT v, 0, 1 FROM ({_B})), n AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1),
        c AS (SELECT lead(v) OVER (ORDER BY v) - v AS gap, sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM u) AS fa, sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM u) AS fb FROM n) SELECT sum(gap * abs(fa - fb)) AS wasserstein FROM c""",
    "wasserstein",
)
def wasserstein_distance(read):
    return M.wasserstein(*_two(read), "o_totalprice")


@query(
    f"""WITH q AS (SELECT y, p * 0.7 AS lo, p AS mid, p * 1.2 AS hi FROM {R}), l AS (SELECT *, greatest(0.05 * (y - lo), -0.95 * (y - lo)) AS a, greatest(0.5 * (y - mid), -0.5 * (y - mid)) AS b, greatest(0.95 * (y - hi), -0.05 * (y - hi)) AS c FROM q)
        SELECT avg(a) AS pinball_lo, avg(b) AS pinball_mid, avg(c) AS pinball_hi, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg(hi - lo) AS width, avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0))) AS winkler, avg(2 * (a + b + c) / 3) AS crps FROM l""",
    "pinball_lo pinball_mid pinball_hi coverage width winkler crps",
    5,
)
def pinball_coverage(read):
    p = priced(read)
    return M.quantile_scores(p.withColumn("lo", F.col("p") * 0.7).withColumn("mid", F.col("p")).withColumn("hi", F.col("p") * 1.2), "y", "lo", "mid", "hi")


def _labels(read):
    return scored(read).select("doc_id", F.array("y", "t").alias("truth"), F.array(F.col("p"), F.col("p2")).alias("score"))


@query(
    f"""WITH r AS (SELECT doc_id, unnest([y, t]) AS t, unnest([p, p2]) AS s FROM {S}), g AS (SELECT doc_id, t, s, count(*) OVER w AS ge, sum(t) OVER w AS gp, sum(t) OVER (PARTITION BY doc_id) AS P, sum(1 - t) OVER (PARTITION BY doc_id) AS N, max(s) OVER (PARTITION BY doc_id) AS top
          FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC)),
        e AS (SELECT doc_id, coalesce(avg(gp / ge) FILTER (t = 1), 1) AS lrap, coalesce(max(ge) FILTER (t = 1), 0) AS coverage, coalesce(sum(ge - gp) FILTER (t = 1) / nullif(max(P) * max(N), 0), 0) AS ranking_loss,
          1 - max(t) FILTER (s = top) AS one_error, avg(((s >= 0.5)::INT <> t)::INT) AS hamming, 1 - max(((s >= 0.5)::INT <> t)::INT) AS subset FROM g GROUP BY 1)
        SELECT avg(lrap) AS lrap, avg(coverage) AS coverage, avg(ranking_loss) AS ranking_loss, avg(one_error) AS one_error, avg(hamming) AS hamming, avg(subset) AS subset FROM e""",
    "lrap coverage ranking_loss one_error hamming subset",
)
def multilabel_ranking(read):
    return M.multilabel_scores(_labels(read), "doc_id", "truth", "score")


@query(
    f"""WITH r AS (SELECT unnest([1, 2]) AS i, unnest([y, t]) AS t, unnest([(p >= 0.5)::INT, (p2 >= 0.5)::INT]) AS p FROM {S}), c AS (SELECT i, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM r GROUP BY 1)
        SELECT avg(2 * tp / (2 * tp + fp + fn)) AS f1_macro, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1_micro, sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn) AS f1_weighted, avg(tp / (tp + fp + fn)) AS jaccard_macro FROM c""",
    "f1_macro f1_micro f1_weighted jaccard_macro",
)
def multilabel_f1(read):
    return M.multilabel_f1(_labels(read), "doc_id", "truth", "score")


@query("SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1, 2", "rate")
def class_grid(read):
    o = read("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return M.class_grid(o, "o_orderpriority", F.year("o_orderdate"), "y")
