"""The registered queries of the analytics engine and their oracle SQL.

The driver's tables stand in for clinical data: a customer is a patient, the
market segment its group, an order priority a symptom; finished orders are the
signal arm and open ones the noise arm. Conversations are notes, labels
ratings, part names terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import terms
from tandem.operators import extract, mapping, metrics, paired, panels, resample, strata

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def records(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """One arm: (group, patient_id, symptoms)."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select("o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("group"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("group", F.col("o_custkey").alias("patient_id")).agg(F.collect_set("o_orderpriority").alias("symptoms"))


def arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return records(spark, sf_dir, "F"), records(spark, sf_dir, "O")


def tested(spark: SparkSession, sf_dir: str, scope: str = "within-drug") -> DataFrame:
    return paired.false_discovery(paired.p_values(paired.signals(paired.pair_counts(*arms(spark, sf_dir)))), scope=scope)


ARMS = """
arm AS (SELECT DISTINCT c_mktsegment AS g, c_custkey AS p, o_orderpriority AS x, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT g, p, x FROM arm WHERE st = 'F'), k AS (SELECT g, p, x FROM arm WHERE st = 'O'),
both_arms AS (SELECT g, p FROM s INTERSECT SELECT g, p FROM k)"""
COUNTS = f"""WITH {ARMS},
c AS (SELECT a.g, a.x, t.n,
        (SELECT count(*) FROM s JOIN both_arms USING (g, p) WHERE s.g = a.g AND s.x = a.x) AS ns,
        (SELECT count(*) FROM k JOIN both_arms USING (g, p) WHERE k.g = a.g AND k.x = a.x) AS nk,
        (SELECT count(*) FROM s JOIN k USING (g, p, x) WHERE s.g = a.g AND s.x = a.x) AS nb
      FROM (SELECT DISTINCT g, x FROM s) a JOIN (SELECT g, count(*) AS n FROM both_arms GROUP BY g) t USING (g)),
v AS (SELECT *, (ns - nk) / n AS d, sqrt((ns + nk - 2 * nb - (ns - nk) * (ns - nk) / n) / (n - 1) / n) AS se FROM c),
r AS (SELECT *, CASE WHEN n < 2 OR (se = 0 AND d = 0) THEN 0.0 WHEN se = 0 THEN sign(d) * 'inf'::DOUBLE ELSE d / se END AS t FROM v)"""
DENSITY = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + u * u / df, -(df + 1) / 2.0)"


def simpson(f: str, upper: str) -> str:
    """The integral of f(u) from 0 to an expression, by 2000 steps."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({upper}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * {f.replace('u * u', f'pow(i * ({upper}) / 2000, 2)')}))"


T_TAIL = f"CASE WHEN t = 0 THEN 1.0 WHEN isinf(t) THEN 0.0 ELSE greatest(0.0, 1 - 2 * {simpson(DENSITY.replace('df', '(n - 1)'), 'abs(t)')}) END"
PVALUES = f"""{COUNTS}, pv AS (SELECT *, {T_TAIL} AS pval FROM r),
bh AS (SELECT *, least(1.0, min(pval * m / rk) OVER (PARTITION BY g ORDER BY rk DESC)) AS q FROM
       (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pval, x) AS rk, count(*) OVER (PARTITION BY g) AS m FROM pv))"""


@query(f"""{COUNTS} SELECT g AS "group", x AS symptom, ns AS n_patients, n AS total_patients, round(100.0 * ns / n, 6) AS signal_pct, nk AS noise_n,
round(100.0 * nk / n, 6) AS noise_pct, round(100 * d, 6) AS signal_minus_noise, round(t, 6) AS t_stat, CASE WHEN d > 0 THEN 'increased' ELSE 'decreased' END AS direction FROM r""")
def q_paired_signal(spark, sf_dir):
    return rounded(paired.signals(paired.pair_counts(*arms(spark, sf_dir))).drop("n_both"))


@query(f"""{PVALUES} SELECT g AS "group", x AS symptom, round(t, 6) AS t_stat, round(pval, 6) AS p_value FROM pv""")
def q_paired_pvalue(spark, sf_dir):
    return rounded(paired.p_values(paired.signals(paired.pair_counts(*arms(spark, sf_dir)))).select("group", "symptom", "t_stat", "p_value"))


@query(f"""{PVALUES} SELECT g AS "group", x AS symptom, round(pval, 6) AS p_value, round(q, 6) AS q_value, q <= 0.1 AS significant FROM bh""")
def q_bh_within(spark, sf_dir):
    return rounded(tested(spark, sf_dir).select("group", "symptom", "p_value", "q_value", "significant"))


@query(f"""{PVALUES}, a AS (SELECT *, row_number() OVER (ORDER BY pval, x, g) AS rk, count(*) OVER () AS m FROM pv),
b AS (SELECT *, least(1.0, min(pval * m / rk) OVER (ORDER BY rk DESC)) AS q FROM a)
SELECT g AS "group", x AS symptom, round(q, 6) AS q_value, q <= 0.1 AS significant FROM b""")
def q_bh_global(spark, sf_dir):
    return rounded(tested(spark, sf_dir, "global").select("group", "symptom", "q_value", "significant"))


@query(f"""{COUNTS.replace('WITH', 'WITH RECURSIVE', 1)},
w AS (SELECT n, 0::DOUBLE AS lo, 100::DOUBLE AS hi, 0 AS it FROM (SELECT DISTINCT n FROM r) UNION ALL
      SELECT n, CASE WHEN less THEN mid ELSE lo END, CASE WHEN less THEN hi ELSE mid END, it + 1 FROM
        (SELECT *, {simpson(DENSITY.replace('df', '(n - 1)'), 'mid')} < 0.475 AS less FROM (SELECT *, (lo + hi) / 2 AS mid FROM w WHERE it < 50)))
SELECT g AS "group", x AS symptom, round(100 * (d - se * lo), 6) AS diff_ci_lower, round(100 * (d + se * lo), 6) AS diff_ci_upper FROM r JOIN (SELECT * FROM w WHERE it = 50) USING (n)""")
def q_diff_ci(spark, sf_dir):
    return rounded(paired.intervals(paired.signals(paired.pair_counts(*arms(spark, sf_dir)))).select("group", "symptom", "diff_ci_lower", "diff_ci_upper"))


BINOMIAL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid))))"


@query(f"""{COUNTS.replace('WITH', 'WITH RECURSIVE', 1)},
arm_counts AS (SELECT DISTINCT n, ns AS c FROM r UNION SELECT DISTINCT n, nk FROM r),
w AS (SELECT n, c, side, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS it FROM arm_counts, (VALUES ('low'), ('high')) z(side) UNION ALL
      SELECT n, c, side, CASE WHEN less THEN mid ELSE lo END, CASE WHEN less THEN hi ELSE mid END, it + 1 FROM
        (SELECT *, CASE WHEN side = 'low' THEN coalesce({BINOMIAL.format(a='c', b='n + 1')}, 1) < 0.025 ELSE coalesce({BINOMIAL.format(a='0', b='c + 1')}, 1) > 0.025 END AS less
         FROM (SELECT *, (lo + hi) / 2 AS mid FROM w WHERE it < 50))),
e AS (SELECT n, c, max(CASE WHEN side = 'low' THEN CASE WHEN c = 0 THEN 0 ELSE lo END END) AS low, max(CASE WHEN side = 'high' THEN CASE WHEN c = n THEN 1 ELSE lo END END) AS high FROM w WHERE it = 50 GROUP BY n, c)
SELECT g AS "group", x AS symptom, round(100 * a.low, 6) AS signal_ci_lower, round(100 * a.high, 6) AS signal_ci_upper, round(100 * b.low, 6) AS noise_ci_lower, round(100 * b.high, 6) AS noise_ci_upper
FROM r JOIN e a ON a.n = r.n AND a.c = r.ns JOIN e b ON b.n = r.n AND b.c = r.nk""")
def q_clopper_pearson(spark, sf_dir):
    rows = paired.intervals(paired.signals(paired.pair_counts(*arms(spark, sf_dir))))
    return rounded(rows.select("group", "symptom", "signal_ci_lower", "signal_ci_upper", "noise_ci_lower", "noise_ci_upper"))


@query()
def q_bayes(spark, sf_dir):
    return paired.bayes(*arms(spark, sf_dir))


def covariates(spark, sf_dir):
    """(patient_id, region, half) of all customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("patient_id"), F.col("r_name").alias("region"), F.when(F.col("c_nationkey") < 12, "low").otherwise("high").alias("half"))


COVARIATES = "cov AS (SELECT c_custkey AS p, r_name AS region, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS half FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {ARMS}, {COVARIATES},
e AS (SELECT a.g, a.x, b.p, region, CASE WHEN s.p IS NULL THEN 0.0 ELSE 1 END AS sv, CASE WHEN k.p IS NULL THEN 0.0 ELSE 1 END AS kv
      FROM (SELECT DISTINCT g, x FROM s) a JOIN both_arms b USING (g) JOIN cov ON cov.p = b.p LEFT JOIN s ON s.g = a.g AND s.x = a.x AND s.p = b.p LEFT JOIN k ON k.g = a.g AND k.x = a.x AND k.p = b.p),
d AS (SELECT *, sv - avg(kv) OVER (PARTITION BY g, x, region) AS rr FROM e),
z AS (SELECT g, x, count(*) AS n, avg(rr) AS mean, stddev_samp(rr) AS sd FROM d GROUP BY g, x),
y AS (SELECT *, mean / (sd / sqrt(n)) AS t FROM z)
SELECT g AS "group", x AS symptom, round(100 * mean, 5) AS lr_resid_mean, round({T_TAIL}, 5) AS lr_resid_p FROM y""")
def q_cov_residual(spark, sf_dir):
    return rounded(paired.residual_tests(*arms(spark, sf_dir), covariates(spark, sf_dir).select("patient_id", "region")), 5)


STRATA = f"""WITH {ARMS}, {COVARIATES}, st AS (SELECT p, 'region' AS kind, region AS val FROM cov UNION ALL SELECT p, 'half', half FROM cov),
m AS (SELECT r.st, r.g, kind, val, count(*) AS n FROM (SELECT DISTINCT g, p, st FROM arm) r JOIN st USING (p) GROUP BY ALL),
ev AS (SELECT arm.st, g, x, kind, val, count(*) AS n FROM arm JOIN st USING (p) GROUP BY ALL),
t AS (SELECT a.g, a.x, m.kind, m.val, m.n, coalesce(e.n, 0) AS ev, coalesce(m2.n, 0) AS n2, coalesce(e2.n, 0) AS ev2
      FROM (SELECT DISTINCT g, x FROM s) a JOIN m ON m.g = a.g AND m.st = 'F'
      LEFT JOIN ev e ON e.st = 'F' AND e.g = a.g AND e.x = a.x AND e.kind = m.kind AND e.val = m.val
      LEFT JOIN m m2 ON m2.st = 'O' AND m2.g = a.g AND m2.kind = m.kind AND m2.val = m.val
      LEFT JOIN ev e2 ON e2.st = 'O' AND e2.g = a.g AND e2.x = a.x AND e2.kind = m.kind AND e2.val = m.val),
w AS (SELECT *, count(*) OVER q AS strata, sum(ev) OVER q AS all_e, sum(n) OVER q AS all_n FROM t WINDOW q AS (PARTITION BY g, x, kind)),
o AS (SELECT *, greatest(0, abs(ev - n * all_e / all_n) - CASE WHEN strata = 2 THEN 0.5 ELSE 0 END) AS off FROM w),
chi AS (SELECT g, x, kind, max(strata) AS k, CASE WHEN max(strata) >= 2 AND max(all_e) > 0 AND max(all_e) < max(all_n) THEN sum(off * off / (n * all_e / all_n) + off * off / (n * (1 - all_e / all_n))) END AS c FROM o GROUP BY ALL),
het AS (SELECT *, CASE WHEN k = 5 THEN exp(-c / 2) * (1 + c / 2) WHEN k = 2 THEN 1 - 2 * {simpson('exp(-u * u / 2) / sqrt(2 * pi())', 'sqrt(c)')} END AS hp FROM chi)"""


@query(f"""{STRATA} SELECT t.g AS "group", t.x AS symptom, t.kind AS stratum_type, val AS stratum_value, n AS n_patients, round(100.0 * ev / n, 2) AS signal_pct,
round(CASE WHEN n2 > 0 THEN 100.0 * ev2 / n2 ELSE 0.0 END, 2) AS noise_pct, round(100.0 * ev / n - CASE WHEN n2 > 0 THEN 100.0 * ev2 / n2 ELSE 0.0 END, 2) AS signal_minus_noise, round(hp, 6) AS heterogeneity_p
FROM t JOIN het ON het.g = t.g AND het.x = t.x AND het.kind = t.kind""")
def q_subgroup_strata(spark, sf_dir):
    return strata.subgroups(*arms(spark, sf_dir), covariates(spark, sf_dir), ["region", "half"])


@query(f"""{STRATA} SELECT g AS "group", x AS symptom, kind AS stratum_type, k AS n_strata, round(c, 6) AS chi2, round(hp, 6) AS heterogeneity_p FROM het""")
def q_heterogeneity(spark, sf_dir):
    counts = strata.strata_counts(*arms(spark, sf_dir), strata.strata_of(covariates(spark, sf_dir), ["region", "half"]))
    return rounded(strata.heterogeneity(counts))


@query(f"""{PVALUES} SELECT g AS "group", x AS symptom, round(100.0 * ns / n, 6) AS signal_pct, round(100 * d, 6) AS signal_minus_noise, round(q, 6) AS q_value
FROM bh WHERE q <= 0.1 ORDER BY 100 * d DESC, g, x LIMIT 25""")
def q_top_signals(spark, sf_dir):
    return rounded(panels.top_signals(tested(spark, sf_dir)))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
e AS (SELECT sum(x.n * y.n) AS xy FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON x.a = y.b)
SELECT CAST(n AS BIGINT) AS n, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM t, e""")
def q_cohen_kappa(spark, sf_dir):
    return rounded(metrics.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


def ratings(spark, sf_dir):
    """Three raters of labelled documents, the third of which leaves some out."""
    labels = table(spark, sf_dir, "labels")
    third = F.when(F.col("doc_id") % 3 != 0, F.col("quality") * (1 - F.col("toxic")))
    return labels.select("doc_id", F.col("quality").alias("r1"), F.col("toxic").alias("r2"), third.alias("r3"))


@query("""WITH c AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels) GROUP BY ALL),
p AS (SELECT count(*) AS k, avg((sq - 2) / 2) AS p FROM (SELECT doc_id, sum(n * n) AS sq FROM c GROUP BY doc_id)),
e AS (SELECT sum(pow(n / a, 2)) AS e FROM (SELECT v, sum(n) AS n FROM c GROUP BY v), (SELECT sum(n) AS a FROM c))
SELECT k AS n_items, round((p - e) / (1 - e), 6) AS kappa FROM p, e""")
def q_fleiss_kappa(spark, sf_dir):
    rows = ratings(spark, sf_dir).unpivot("doc_id", ["r1", "r2"], "rater", "category")
    return rounded(metrics.fleiss_kappa(rows.groupBy(F.col("doc_id").alias("item"), "category").agg(F.count(F.lit(1)).alias("n"))))


@query("""WITH r AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, quality * (1 - toxic) FROM labels WHERE doc_id % 3 <> 0),
c AS (SELECT doc_id, v, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT doc_id, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY doc_id HAVING sum(n) >= 2),
t AS (SELECT count(*) AS k, sum(m) AS n, sum(m - same / (m - 1)) AS off FROM i), w AS (SELECT sum(x * x) AS vv FROM (SELECT v, sum(n) AS x FROM c JOIN i USING (doc_id) GROUP BY v))
SELECT k AS n_items, round(1 - off / ((n * n - vv) / (n - 1)), 6) AS alpha FROM t, w""")
def q_krippendorff_alpha(spark, sf_dir):
    rows = ratings(spark, sf_dir).unpivot("doc_id", ["r1", "r2", "r3"], "rater", "value").withColumnRenamed("doc_id", "item")
    return rounded(metrics.krippendorff_alpha(rows))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS p, o_orderstatus AS st, o_orderpriority AS x FROM orders), h AS (SELECT f.p, count(*) AS h FROM a f JOIN a o ON f.p = o.p AND f.x = o.x WHERE f.st = 'F' AND o.st = 'O' GROUP BY f.p),
n AS (SELECT o_custkey AS p, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS np, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS nt FROM orders GROUP BY 1)
SELECT p AS patient_id, round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE coalesce(h, 0) / np END, 6) AS "precision", round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE coalesce(h, 0) / nt END, 6) AS recall,
round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 ELSE 2.0 * coalesce(h, 0) / (np + nt) END, 6) AS f1 FROM n LEFT JOIN h USING (p)""")
def q_set_f1(spark, sf_dir):
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(metrics.set_scores(of("F"), of("O")).alias("v"))
    return rounded(rows.select("patient_id", "v.precision", "v.recall", "v.f1"))


def annotations(spark, sf_dir):
    """Three annotators: each has the orders of one remainder of the key."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("annotator"), F.col("o_custkey").alias("patient_id"), "o_orderpriority")
    return rows.groupBy("annotator", "patient_id").agg(F.collect_set("o_orderpriority").alias("terms"))


def models(spark, sf_dir):
    """Three models: the orders of one status; their time comes from the price."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("patient_id"))
    return rows.agg(F.collect_set("o_orderpriority").alias("symptoms"), (F.max("o_totalprice") / 10_000).alias("extraction_time_s"))


BENCH = """v AS (SELECT DISTINCT o_orderkey % 3 AS a, o_custkey AS p, lower(o_orderpriority) AS x FROM orders), seen AS (SELECT p, count(DISTINCT a) AS k FROM v GROUP BY p),
truth AS (SELECT p, x FROM v JOIN seen USING (p) GROUP BY p, x, k HAVING count(*) >= k / 2),
pr AS (SELECT DISTINCT o_orderstatus AS m, o_custkey AS p, lower(o_orderpriority) AS x FROM orders), ms AS (SELECT DISTINCT m FROM pr),
g AS (SELECT m, p, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(h, 0) AS h FROM ms CROSS JOIN seen LEFT JOIN (SELECT m, p, count(*) AS np FROM pr GROUP BY ALL) USING (m, p)
      LEFT JOIN (SELECT p, count(*) AS nt FROM truth GROUP BY p) USING (p) LEFT JOIN (SELECT m, p, count(*) AS h FROM pr JOIN truth USING (p, x) GROUP BY ALL) USING (m, p)),
f AS (SELECT *, CASE WHEN np + nt = 0 THEN 1.0 ELSE 2.0 * h / (np + nt) END AS f1 FROM g),
a AS (SELECT m, avg(f1) AS macro, avg(CASE WHEN nt > 0 THEN f1 END) AS sym, avg(np - nt) AS bias FROM f GROUP BY m),
rr AS (SELECT x, count(*) / (SELECT count(*) FROM seen) AS r FROM truth GROUP BY x), pp AS (SELECT m, x, count(*) / (SELECT count(*) FROM seen) AS q FROM pr SEMI JOIN seen USING (p) GROUP BY ALL),
w AS (SELECT m, sum(r * abs(coalesce(q, 0) - r)) / sum(r) AS mae FROM ms CROSS JOIN rr LEFT JOIN pp USING (m, x) GROUP BY m),
tm AS (SELECT o_orderstatus AS m, avg(t) AS t FROM (SELECT o_orderstatus, o_custkey, max(o_totalprice) / 10000 AS t FROM orders GROUP BY ALL) GROUP BY 1),
bench AS (SELECT m AS model, round(macro, 6) AS macro_f1, round(sym, 6) AS symptomatic_f1, round(mae, 6) AS weighted_mae, round(t, 4) AS mean_inference_s, round(bias, 6) AS bias FROM a JOIN w USING (m) JOIN tm USING (m))"""


@query(f"WITH {BENCH} SELECT * FROM bench")
def q_bench_models(spark, sf_dir):
    return metrics.model_scores(models(spark, sf_dir), metrics.ground_truth(annotations(spark, sf_dir), "majority"))


@query(f"WITH {BENCH} SELECT model, 'macro_f1' AS metric, macro_f1 AS score, row_number() OVER (ORDER BY macro_f1 DESC, model) AS rank, row_number() OVER (ORDER BY macro_f1 DESC, model) = 1 AS leader FROM bench")
def q_lollipop(spark, sf_dir):
    return metrics.lollipop_order(q_bench_models(spark, sf_dir))


@query(f"""WITH {BENCH}, l AS (SELECT quantile_cont(mean_inference_s, 0.5) AS t, quantile_cont(weighted_mae, 0.5) AS e FROM bench)
SELECT model, CASE WHEN weighted_mae <= e AND mean_inference_s <= t THEN 0 WHEN weighted_mae <= e THEN 1 ELSE 2 END AS tier FROM bench, l ORDER BY 2, mean_inference_s, 1 LIMIT 1""")
def q_production_pick(spark, sf_dir):
    return metrics.production_pick(q_bench_models(spark, sf_dir))


@query("""WITH v AS (SELECT DISTINCT CAST(o_orderkey % 3 AS VARCHAR) AS a, o_custkey AS p, lower(o_orderpriority) AS x FROM orders), n AS (SELECT a, p, count(*) AS n FROM v GROUP BY ALL),
f AS (SELECT l.a AS a, r.a AS b, l.p, 2.0 * (SELECT count(*) FROM v y JOIN v z USING (x) WHERE y.a = l.a AND y.p = l.p AND z.a = r.a AND z.p = l.p) / (l.n + r.n) AS f1 FROM n l JOIN n r ON l.p = r.p AND l.a < r.a),
pf AS (SELECT a, b, avg(f1) AS f1 FROM f GROUP BY ALL), sh AS (SELECT p FROM n GROUP BY p HAVING count(*) = 3), said AS (SELECT v.* FROM v SEMI JOIN sh USING (p)),
items AS (SELECT sh.p, x.x, (SELECT count(*) FROM said WHERE said.p = sh.p AND said.x = x.x) AS y FROM sh CROSS JOIN (SELECT DISTINCT x FROM said) x),
t AS (SELECT sum(y) AS yes, 3 * count(*) AS n, sum(y * (3 - y)) AS off, count(DISTINCT p) AS np, count(DISTINCT x) AS nx FROM items)
SELECT round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max, round(avg(f1), 6) AS f1_mean, count(*) AS n_pairs, any_value(np) AS n_patients, any_value(nx) AS n_terms,
round(any_value(1 - off / (2.0 * yes * (n - yes) / (n - 1))), 6) AS alpha FROM pf, t""")
def q_agreement(spark, sf_dir):
    return rounded(metrics.agreement(annotations(spark, sf_dir)))


RATES = """CASE p_size % 6 WHEN 0 THEN p_size || '%' WHEN 1 THEN '<' || p_size || ' %' WHEN 2 THEN p_size || '% to ' || (p_size + 5) || '%' WHEN 3 THEN '>= ' || p_size || '.5%' WHEN 4 THEN 'n/a' ELSE CAST(p_size AS {}) END"""


@query(f"""SELECT p_partkey, rate, round(CASE WHEN lower(trim(rate)) IN ('', 'n/a', 'na', 'none', 'nd') THEN NULL
WHEN regexp_matches(rate, '\\d\\s*%?\\s*(to|-)\\s*\\d') THEN (CAST(regexp_extract(rate, '(\\d+(\\.\\d+)?)\\s*%?\\s*to', 1) AS DOUBLE) + CAST(regexp_extract(rate, 'to\\s*(\\d+(\\.\\d+)?)', 1) AS DOUBLE)) / 2
WHEN rate LIKE '<%' THEN CAST(regexp_extract(rate, '(\\d+(\\.\\d+)?)\\s*%', 1) AS DOUBLE) / 2 WHEN rate LIKE '%\\%' ESCAPE '\\' THEN CAST(regexp_extract(rate, '(\\d+(\\.\\d+)?)\\s*%', 1) AS DOUBLE) END, 6) AS midpoint
FROM (SELECT p_partkey, {RATES.format('VARCHAR')} AS rate FROM part)""")
def q_rate_midpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(RATES.format("STRING")).alias("rate"))
    return rounded(rows.withColumn("midpoint", terms.rate_midpoint(F.col("rate"))))


def comparison(spark, sf_dir):
    """Published rates made from the segments and priorities: the first digit, thrice and more."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group")).distinct().crossJoin(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term")).distinct())
    rate = F.concat((F.length("group") * 3 + F.substring("term", 1, 1).cast("int") * 5).cast("string"), F.lit("%"))
    dumps = pairs.select("group", F.lit(0).alias("pos"), F.upper("term").alias("term"), rate.alias("rate"))
    return panels.reference_comparison(paired.signals(paired.pair_counts(*arms(spark, sf_dir))), panels.reference_rates(dumps))


REFERENCE = f"{COUNTS}, ref AS (SELECT g, x, 100.0 * ns / n AS o, length(g) * 3 + CAST(substr(x, 1, 1) AS INT) * 5.0 AS rate FROM r), ratios AS (SELECT o / rate AS ratio, o, rate FROM ref WHERE rate > 0)"


@query(f"""{REFERENCE} SELECT g AS "group", x AS symptom, round(o, 6) AS observed_signal_pct, round(rate, 6) AS reference_rate, 'reference' AS source FROM ref""")
def q_reference_join(spark, sf_dir):
    return rounded(comparison(spark, sf_dir))


@query(f"{REFERENCE} SELECT count(*) AS n, round(sum(o * rate) / sum(rate * rate), 6) AS slope, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, round(quantile_cont(ratio, 0.95), 6) AS p95_ratio FROM ratios")
def q_ols_ratio(spark, sf_dir):
    return rounded(panels.reference_fit(comparison(spark, sf_dir)))


@query(f"""{REFERENCE}, t AS (SELECT greatest(1.2, quantile_cont(ratio, 0.95)) AS top FROM ratios), h AS (SELECT least(16, CAST(floor(ratio / (top / 17)) AS INT)) AS bin, count(*) AS n FROM ratios, t WHERE ratio <= top GROUP BY 1)
SELECT CAST(b AS INT) AS bin, round(top / 17 * b, 6) AS low, round(top / 17 * (b + 1), 6) AS high, coalesce(n, 0) AS n FROM range(0, 17) q(b) CROSS JOIN t LEFT JOIN h ON h.bin = b""")
def q_ratio_histogram(spark, sf_dir):
    return rounded(panels.ratio_histogram(comparison(spark, sf_dir)))


TERMS = """CASE p_partkey % 8 WHEN 0 THEN 'Severe ' || p_name || ' in the left arm' WHEN 1 THEN p_name || '/' || p_type WHEN 2 THEN p_name || ' and  mild ' || p_type WHEN 3 THEN 'new  ' || p_name || ' sensation'
WHEN 4 THEN p_name || ', ' || p_type || ' right; x & y' WHEN 5 THEN 'chronic ' || p_type || ' of head and neck' WHEN 6 THEN p_name || ' on  the upper left back symptoms' ELSE 'in left' END"""


def _cleaned_sql(x: str) -> str:
    s = f"regexp_replace(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '^(?:{'|'.join(terms.LEADING_MODIFIERS)})\\s+', '')"
    for pattern in terms.TRAILING:
        s = f"(CASE WHEN trim(regexp_replace({s}, '{pattern}', '', 'i')) <> '' THEN trim(regexp_replace({s}, '{pattern}', '', 'i')) ELSE {s} END)"
    return s


@query(f"""WITH t AS (SELECT p_partkey, {TERMS} AS raw FROM part), q AS (SELECT p_partkey, raw, unnest(regexp_split_to_array(raw, '(?i)\\s*(?:/|,|;|&|\\band\\b)\\s*')) AS part FROM t)
SELECT p_partkey, trim(part) AS part, {_cleaned_sql('part')} AS preprocessed FROM q WHERE trim(part) <> ''""")
def q_split_preprocess(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(terms.split_compound(F.expr(TERMS))).alias("part"))
    return rows.withColumn("preprocessed", terms.preprocess_term(F.col("part")))


NON_TERM = """CASE p_partkey % 14 WHEN 0 THEN p_name WHEN 1 THEN 'None reported' WHEN 2 THEN 'no side effects' WHEN 3 THEN '12/05/' || p_size WHEN 4 THEN p_size || '.5 %' WHEN 5 THEN ' ab ' WHEN 6 THEN 'Due to ' || p_name WHEN 7 THEN 'n.o.s.'
WHEN 8 THEN repeat(p_name, 20) WHEN 9 THEN '' WHEN 10 THEN 'nonexistent ' || p_name WHEN 11 THEN 'not clearly ' || p_type WHEN 12 THEN 'N/A' ELSE 'noted ' || p_type END"""


@query(f"""SELECT p_partkey, raw, trim(raw) = '' OR length(trim(raw)) > 150 OR {' OR '.join(f"regexp_matches(trim(raw), '(?i){p}')" for p in terms.NON_TERMS)} AS non_symptom FROM (SELECT p_partkey, {NON_TERM} AS raw FROM part)""")
def q_non_symptom(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(NON_TERM).alias("raw"))
    return rows.withColumn("non_symptom", terms.is_non_symptom(F.col("raw")))


PART_RULES = [(r"(?:\bred\b)|(?:blue)", "Warm Or Cold"), (r"\bpla", "Plate"), ("e", "Has E"), (".", "Any")]


@query("SELECT p_name AS term, CASE " + " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{c}'" for p, c in PART_RULES) + " END AS canonical FROM (SELECT DISTINCT p_name FROM part)")
def q_rules(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    return mapping.first_rule(names, mapping.rules_table(spark, PART_RULES))


@query()
def q_mapping_build(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.expr(TERMS).alias("raw_term"))
    return mapping.build_mapping(raw, ["Red Plate", "Blue Rod", "Promo"], PART_RULES[:2])


@query(f"""WITH m AS (SELECT DISTINCT {_cleaned_sql('p_name')} AS pre, upper(p_name) AS norm FROM part WHERE substr(p_name, 1, 1) < 'm'),
t AS (SELECT DISTINCT p_brand, p_name || '/' || p_type AS raw FROM part), q AS (SELECT p_brand, unnest(regexp_split_to_array(raw, '(?i)\\s*(?:/|,|;|&|\\band\\b)\\s*')) AS part FROM t)
SELECT p_brand AS patient_id, coalesce(array_to_string(list_sort(list(DISTINCT norm) FILTER (norm IS NOT NULL)), '|'), '') AS symptoms FROM q LEFT JOIN m ON m.pre = {_cleaned_sql('part')} GROUP BY p_brand""")
def q_mapping_apply(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.groupBy(F.col("p_brand").alias("patient_id")).agg(F.collect_set(F.concat_ws("/", "p_name", "p_type")).alias("symptoms"))
    made = part.filter("substr(p_name, 1, 1) < 'm'").select("p_name").distinct()
    made = made.select(F.col("p_name").alias("raw_term"), terms.preprocess_term(F.col("p_name")).alias("preprocessed_term"), F.upper("p_name").alias("normalized_term"), F.lit("rule").alias("tier"))
    return mapping.apply_mapping(rows, made).select("patient_id", F.array_join("symptoms", "|").alias("symptoms"))


@query()
def q_fuzzy(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    wrong = names.select(F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substring(p_name, 4)")).alias("term"))
    return mapping.vocabulary_match(wrong.distinct(), ["red plate", "blue rod", "green gear", "small bolt", "large nut"])


ALIASES = {"the": "drug a", "und": "drug b", "des": "drug c", "que de": "drug d"}


@query()
def q_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", terms.mask_names(F.col("text"), ALIASES).alias("masked"))
    return rows.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked_md5"), terms.leaks(F.col("masked"), ALIASES).alias("leaked"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(^|[^\\p{L}\\p{N}_])(the|und|des|que de)($|[^\\p{L}\\p{N}_])') AS leaked FROM documents")
def q_leak(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", terms.leaks(F.coalesce("text", F.lit("")), ALIASES).alias("leaked"))


def notes(spark, sf_dir):
    """A conversation is a patient: what the user said comes before, what the assistant said after."""
    rows = table(spark, sf_dir, "conversations")
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    out = rows.groupBy("conv_id").agg(side("user").alias("pre_notes"), side("assistant").alias("post_notes"))
    return out.select(F.col("conv_id").cast("string").alias("patient_id"), F.concat(F.lit("g"), F.col("conv_id") % 3).alias("group"), "pre_notes", "post_notes")


PROMPT = "About {alias}. Before: {pre_notes} After: {post_notes} End."


@query("""WITH w AS (SELECT conv_id, coalesce(string_agg(text, E'\\n\\n---\\n\\n' ORDER BY turn, text) FILTER (role = 'user'), '') AS a, coalesce(string_agg(text, E'\\n\\n---\\n\\n' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS b FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS patient_id, length(p) AS chars, md5(p) AS prompt_md5 FROM (SELECT conv_id, replace(replace('About the index medication. Before: {pre_notes} After: {post_notes} End.', '{pre_notes}', a[:524288]), '{post_notes}', b[:524288]) AS p FROM w)""")
def q_windows_prompt(spark, sf_dir):
    rows = notes(spark, sf_dir)
    prompt = terms.fill_prompt(F.lit(PROMPT), terms.index_token(F.lit(None).cast("string"), {}), terms.window_text(F.col("pre_notes")), terms.window_text(F.col("post_notes")))
    return rows.select("patient_id", prompt.alias("p")).select("patient_id", F.length("p").alias("chars"), F.md5(F.col("p").cast("binary")).alias("prompt_md5"))


@query()
def q_extract(spark, sf_dir):
    rows = extract.extract(extract.prompts(notes(spark, sf_dir), {"g0": "drug a", "g1": "drug b", "g2": "drug c"}))
    return rows.select("patient_id", "group", F.array_sort("symptoms").alias("symptoms"), "error")


ANSWERS = """CASE event_id % 5 WHEN 0 THEN '```json\n{{"side_effects": ["' || event_type || '", " u' || (user_id % 7) || ' "]}}\n```' WHEN 1 THEN 'So: {{"side_effects": [{{"symptom": "' || event_type || '"}}, ""]}} done'
WHEN 2 THEN '["' || event_type || '"]' WHEN 3 THEN 'nothing {{broken' ELSE {} END"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '|u' || (user_id % 7) WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN '' ELSE '' END AS found FROM events""")
def q_json_list(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(ANSWERS.format("props")).alias("answer"))
    return rows.select("event_id", F.array_join(terms.string_list(F.col("answer"), "side_effects"), "|").alias("found"))


@query("""WITH n AS (SELECT conv_id, 'g' || (conv_id % 3) AS g, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)
SELECT g AS "group", CAST(conv_id AS VARCHAR) AS patient_id, CASE WHEN t > 0 THEN a ELSE 0 END AS n_pre, CASE WHEN t > 0 THEN b ELSE 0 END AS n_post, true AS from_pool FROM n JOIN (SELECT g, sum(a) AS t FROM n GROUP BY g) USING (g)""")
def q_surrogate(spark, sf_dir):
    real = notes(spark, sf_dir)
    made = resample.surrogates(real, seed=7).withColumn("text", F.explode_outer(F.concat("pre_notes", "post_notes")))
    held = real.select("group", F.explode("pre_notes").alias("text")).distinct().withColumn("known", F.lit(True))
    rows = made.join(held, ["group", "text"], "left").groupBy("group", "patient_id")
    return rows.agg(F.size(F.first("pre_notes")).cast("long").alias("n_pre"), F.size(F.first("post_notes")).cast("long").alias("n_post"), F.bool_and(F.col("text").isNull() | F.coalesce("known", F.lit(False))).alias("from_pool"))


@query(f"{PVALUES} SELECT x AS symptom, CAST(sum(CASE WHEN q <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, round(avg(100 * d), 6) AS mean_delta, row_number() OVER (ORDER BY sum(CASE WHEN q <= 0.1 THEN 1 ELSE 0 END) DESC, avg(100 * d) DESC, x) AS position FROM bh GROUP BY x")
def q_symptom_order(spark, sf_dir):
    return rounded(panels.symptom_order(tested(spark, sf_dir)))


@query(f"""{PVALUES} SELECT a.g AS "group", b.x AS symptom, round(coalesce(100 * d, 0), 6) AS delta, coalesce(q <= 0.1 AND d > 0, false) AS sig, coalesce(q <= 0.1 AND d <= 0, false) AS sig_dec, round(coalesce(100 * d, 0), 6) AS ci_lo, round(coalesce(100 * d, 0), 6) AS ci_hi
FROM (SELECT DISTINCT g FROM bh) a CROSS JOIN (SELECT DISTINCT x FROM bh) b LEFT JOIN bh ON bh.g = a.g AND bh.x = b.x""")
def q_panel(spark, sf_dir):
    return rounded(panels.panels(tested(spark, sf_dir)))


@query(f"""{COUNTS}, m AS (SELECT g, max(abs(100 * d)) AS reach, least(min(100 * d), 0) AS lo, greatest(max(100 * d), 0) AS hi FROM r GROUP BY g), o AS (SELECT *, (row_number() OVER (ORDER BY reach DESC, g) - 1) // 2 AS rw FROM m)
SELECT g AS "group", round(reach, 6) AS reach, CAST(rw AS INT) AS row, row_number() OVER (PARTITION BY rw ORDER BY g) AS side, floor((min(lo) OVER (PARTITION BY rw) - 0.5) * 2) / 2 AS y_low, ceil((max(hi) OVER (PARTITION BY rw) + 0.5) * 2) / 2 AS y_high FROM o""")
def q_row_pairs(spark, sf_dir):
    return rounded(panels.row_pairs(panels.panels(paired.signals(paired.pair_counts(*arms(spark, sf_dir))))))


@query(f"""{COUNTS}, pf AS (SELECT g, list(greatest(100 * d, 0) ORDER BY x) AS v FROM r GROUP BY g)
SELECT a.g AS a, b.g AS b, round(1 - CASE WHEN list_sum(list_transform(a.v, lambda q: q * q)) = 0 OR list_sum(list_transform(b.v, lambda q: q * q)) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 6) AS distance FROM pf a JOIN pf b ON a.g < b.g""")
def q_profile_cosine(spark, sf_dir):
    matrix = panels.profile_matrix(paired.signals(paired.pair_counts(*arms(spark, sf_dir))))
    return rounded(panels.cosine_distances(panels.profiles(matrix)))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, greatest(avg(CAST(v AS DOUBLE)), 0) AS v FROM e GROUP BY ALL), p AS (SELECT CAST(label AS VARCHAR) AS l, list(v ORDER BY i) AS v FROM m GROUP BY label)
SELECT a.l AS a, b.l AS b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM p a JOIN p b ON a.l < b.l""")
def q_embedding_cosine(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = each.groupBy("label", "i").agg(F.greatest(F.avg(F.col("v").cast("double")), F.lit(0.0)).alias("v"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("profile"))
    return rounded(panels.cosine_distances(rows.select(F.col("label").cast("string").alias("label"), "profile")))


@query()
def q_dendrogram(spark, sf_dir):
    return panels.dendrogram(panels.profile_matrix(paired.signals(paired.pair_counts(*arms(spark, sf_dir)))))


@query("""SELECT c_mktsegment AS "group", count(*) AS patients, round(avg(c_acctbal), 1) AS mean_balance FROM customer GROUP BY 1""")
def q_demographics(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("group")).agg(F.avg("c_acctbal").alias("mean_balance"), F.count(F.lit(1)).alias("patients"))
    return panels.demographics_table(rows)
