"""Rules, assertions, reports and comparisons."""

from datetime import datetime

from pyspark.sql import functions as F

from geostrata.operators import clean as C
from geostrata.operators import profile as P
from geostrata.operators import validate as V
from geostrata.operators.schema import FieldSpec, Rule, duplicate_rows, violations
from geostrata.queries.registry import L, R, plain, query, table, view

NOW = datetime(1999, 1, 1)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
# rule id -> (column, rule, SQL predicate of a violating row)
RULES = {
    "rule_not_null": ("amount", Rule("not_null"), "amount IS NULL"),
    "rule_non_negative": ("amount", Rule("non_negative"), "amount < 0"),
    "rule_range": ("num_text", Rule("range", {"min": 5, "max": 90}), "TRY_CAST(num_text AS DOUBLE) < 5 OR TRY_CAST(num_text AS DOUBLE) > 90"),
    "rule_geo_lat": ("lat", Rule("geo_lat"), "lat < -90 OR lat > 90"),
    "rule_geo_lon": ("id", Rule("geo_lon"), "id < -180 OR id > 180"),
    "rule_allowed_values": ("cat", Rule("allowed_values", {"values": PRIORITIES}), "cat IS NOT NULL AND cat NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
    "rule_regex": ("num_text", Rule("regex", {"pattern": "[1-4]"}), "num_text IS NOT NULL AND NOT regexp_matches(num_text, '^(?:[1-4])')"),
}


def _rule_query(name, column, rule, predicate):
    @query(name, f"""SELECT '{column}' AS field, {L('COUNT(*)')} AS violations,
        {R('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM fx_dirty)')} AS rate FROM fx_dirty WHERE {predicate}""")
    def run(spark, sf):
        got = violations(view(spark, sf, "fx_dirty"), [FieldSpec(column, level="required", rules=(rule,))])
        return plain(got.select("field", "violations", "rate"))


for _name, _args in RULES.items():
    _rule_query(_name, *_args)


@query("rule_no_future_date", f"SELECT 'o_orderdate' AS field, {L('COUNT(*)')} AS violations FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01 00:00:00'")
def rule_no_future_date(spark, sf):
    spec = FieldSpec("o_orderdate", rules=(Rule("no_future_date"),))
    return plain(violations(table(spark, sf, "orders"), [spec], now=NOW).select("field", "violations"))


@query("rule_unique", f"SELECT {L('SUM(n)')} AS violations FROM (SELECT COUNT(*) AS n FROM fx_dirty GROUP BY entity, year) WHERE n > 1")
def rule_unique(spark, sf):
    return plain(duplicate_rows(view(spark, sf, "fx_dirty"), ["entity", "year"]))


SPECS = [
    FieldSpec("id", "key", "required", rules=(Rule("not_null"), Rule("unique"))),
    FieldSpec("amount", "numeric", "required", rules=(Rule("not_null"), Rule("non_negative"))),
    FieldSpec("cat", "categorical", "important", rules=(Rule("allowed_values", {"values": PRIORITIES}),)),
    FieldSpec("lat", "spatial", "optional", rules=(Rule("geo_lat"),)),
    FieldSpec("absent", "numeric", "required", rules=(Rule("not_null"),)),
]


@query("rule_violations", f"""
WITH v AS (
SELECT 'id' AS field, 'P0' AS severity, 'unique' AS rule, (SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM fx_dirty GROUP BY id) WHERE n > 1) AS n
UNION ALL SELECT 'amount', 'P0', 'not_null', (SELECT COUNT(*) FROM fx_dirty WHERE amount IS NULL)
UNION ALL SELECT 'amount', 'P0', 'non_negative', (SELECT COUNT(*) FROM fx_dirty WHERE amount < 0)
UNION ALL SELECT 'cat', 'P1', 'allowed_values(values=[''1-URGENT'', ''2-HIGH'', ''3-MEDIUM''])', (SELECT COUNT(*) FROM fx_dirty WHERE {RULES['rule_allowed_values'][2]})
UNION ALL SELECT 'lat', 'P2', 'geo_lat', (SELECT COUNT(*) FROM fx_dirty WHERE lat < -90 OR lat > 90))
SELECT field, severity, rule, {L('n')} AS violations, {R('n * 1.0 / (SELECT COUNT(*) FROM fx_dirty)')} AS rate, CAST(5 AS BIGINT) AS samples FROM v WHERE n > 0""")
def rule_violations(spark, sf):
    got = violations(view(spark, sf, "fx_dirty"), SPECS)
    return plain(got.select("field", "severity", "rule", "violations", "rate", F.size("samples").alias("samples")))


def _check(name, spec, sql_actual, sql_passed):
    @query(name, f"SELECT {R(sql_actual)} AS actual, {L(f'CASE WHEN {sql_passed} THEN 1 ELSE 0 END')} AS passed")
    def run(spark, sf):
        return plain(V.validate(view(spark, sf, "fx_dirty"), [spec]).select("actual", "passed"))


SURPLUS = "(SELECT SUM(n - 1) FROM (SELECT COUNT(*) AS n FROM fx_dirty GROUP BY {k}))"
NULLS = "(SELECT AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)"
OUT = "(SELECT COUNT(*) FROM fx_dirty WHERE amount < 1000 OR amount > 400000)"
NEG = "(SELECT COUNT(*) FROM fx_dirty WHERE amount < 0)"
BAD = "(SELECT COUNT(DISTINCT cat) FROM fx_dirty WHERE cat NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"
ROWS = "(SELECT COUNT(*) FROM fx_dirty)"
_check("chk_unique", {"check": "unique", "field": "id"}, SURPLUS.format(k="id"), f"{SURPLUS.format(k='id')} = 0")
_check("chk_no_duplicates", {"check": "no_duplicates", "subset": ["id", "copy"]}, SURPLUS.format(k="id, copy"), f"{SURPLUS.format(k='id, copy')} = 0")
_check("chk_null_rate_le", {"check": "null_rate_le", "field": "amount", "max": 0.05}, NULLS, f"{NULLS} <= 0.05")
_check("chk_no_negative", {"check": "no_negative", "field": "amount"}, NEG, f"{NEG} = 0")
_check("chk_range", {"check": "range", "field": "amount", "min": 1000, "max": 400000}, OUT, f"{OUT} = 0")
_check("chk_allowed_values", {"check": "allowed_values", "field": "cat", "values": PRIORITIES}, BAD, f"{BAD} = 0")
_check("chk_row_count_ge", {"check": "row_count_ge", "min": 100}, ROWS, f"{ROWS} >= 100")
_check("chk_row_count_le", {"check": "row_count_le", "max": 100}, ROWS, f"{ROWS} <= 100")


def _columns(name, spec, actual, ok):
    @query(name, f"SELECT {R(f'{actual} + 0 * COUNT(*)')} AS actual, CAST({ok} AS BIGINT) AS passed, {L('COUNT(*)')} AS rows FROM fx_dirty")
    def run(spark, sf):
        d = view(spark, sf, "fx_dirty")
        rows = d.agg(F.count("*").alias("rows")).withColumn("_one", F.lit(1))
        rep = V.validate(d, [spec]).select("actual", "passed", F.lit(1).alias("_one"))
        return plain(rep.join(rows, "_one").select("actual", "passed", "rows"))


_columns("chk_column_count_eq", {"check": "column_count_eq", "value": 8}, 8, 1)
_columns("chk_columns_eq", {"check": "columns_eq", "columns": ["id", "entity", "year", "amount", "cat", "lat", "num_text", "extra"]}, 2, 0)

SUITE = [
    {"name": "id unique", "check": "unique", "field": "id", "severity": "P0"},
    {"name": "amount nulls", "check": "null_rate_le", "field": "amount", "max": 0.05, "severity": "P1"},
    {"name": "no negatives", "check": "no_negative", "field": "amount", "severity": "P1"},
    {"name": "latitude", "check": "range", "field": "lat", "min": -90, "max": 90, "severity": "P2"},
    {"name": "size", "check": "row_count_ge", "min": 100, "severity": "P0"},
    {"name": "unknown", "check": "no_such_check", "severity": "P2"},
]


@query("chk_suite", f"""
WITH c AS (SELECT 'P0' AS s, {SURPLUS.format(k='id')} = 0 AS ok UNION ALL SELECT 'P1', {NULLS} <= 0.05 UNION ALL SELECT 'P1', {NEG} = 0
  UNION ALL SELECT 'P2', (SELECT COUNT(*) FROM fx_dirty WHERE lat < -90 OR lat > 90) = 0 UNION ALL SELECT 'P0', {ROWS} >= 100 UNION ALL SELECT 'P2', FALSE)
SELECT {L('COUNT(*)')} AS total, {L('COUNT(*) FILTER (WHERE ok)')} AS passed, {L('COUNT(*) FILTER (WHERE NOT ok)')} AS failed,
  {L("COUNT(*) FILTER (WHERE NOT ok AND s = 'P0')")} AS failed_p0, {L("COUNT(*) FILTER (WHERE NOT ok AND s = 'P1')")} AS failed_p1,
  {L("COUNT(*) FILTER (WHERE NOT ok AND s = 'P2')")} AS failed_p2, {L("MAX(CASE WHEN NOT ok AND s = 'P0' THEN 1 ELSE 0 END)")} AS blocking FROM c""")
def chk_suite(spark, sf):
    return plain(V.report_summary(V.validate(view(spark, sf, "fx_dirty"), SUITE)))


def _cleaned(d):
    plan = C.CleanPlan().drop_na(["amount"]).clip("amount", 0.0, None).fill("cat", "constant", "UNKNOWN").drop_columns(["num_text"])
    return C.clean(d, plan, ["id", "copy"])


AFTER = """a AS (SELECT id, GREATEST(amount, 0) AS amount, COALESCE(cat, 'UNKNOWN') AS cat FROM fx_dirty WHERE amount IS NOT NULL),
bb AS (SELECT QUANTILE_CONT(amount, 0.25) AS q1, QUANTILE_CONT(amount, 0.75) AS q3 FROM fx_dirty),
ab AS (SELECT QUANTILE_CONT(amount, 0.25) AS q1, QUANTILE_CONT(amount, 0.75) AS q3 FROM a),
ob AS (SELECT COUNT(*) AS n FROM fx_dirty, bb WHERE amount < q1 - 0.5 * (q3 - q1) OR amount > q3 + 0.5 * (q3 - q1)),
oa AS (SELECT COUNT(*) AS n FROM a, ab WHERE amount < q1 - 0.5 * (q3 - q1) OR amount > q3 + 0.5 * (q3 - q1))"""


@query("cmp_profiles", f"""
WITH {AFTER}
SELECT 'amount' AS field, {R('(SELECT AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)')} AS null_rate_before, CAST(0 AS DOUBLE) AS null_rate_after,
  {R('-(SELECT AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)')} AS null_rate_diff, (SELECT {L('n')} FROM ob) AS outliers_before, (SELECT {R('n')} FROM oa) AS outliers_after
UNION ALL SELECT 'cat', {R('(SELECT AVG(CASE WHEN cat IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)')}, CAST(0 AS DOUBLE),
  {R('-(SELECT AVG(CASE WHEN cat IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)')}, CAST(0 AS BIGINT), CAST(0 AS DOUBLE)
UNION ALL SELECT 'num_text', CAST(0 AS DOUBLE), NULL, NULL, CAST(0 AS BIGINT), NULL""")
def cmp_profiles(spark, sf):
    d = view(spark, sf, "fx_dirty")
    after = _cleaned(d).data
    cols = ["amount", "cat", "num_text"]
    return plain(V.compare_profiles(
        P.null_table(d.select(*cols)), P.null_table(after.select("amount", "cat")),
        P.outliers(d, "id", "iqr", 0.5, ["amount"]), P.outliers(after, "id", "iqr", 0.5, ["amount"])
    ).withColumn("outliers_after", F.col("outliers_after").cast("double")))


@query("cmp_before_after", f"""
WITH {AFTER}
SELECT 'amount' AS field, {R('(SELECT AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) FROM fx_dirty)')} AS null_rate_before, CAST(0 AS DOUBLE) AS null_rate_after,
  (SELECT {L('COUNT(DISTINCT amount)')} FROM fx_dirty) AS distinct_before, (SELECT {L('COUNT(DISTINCT amount)')} FROM a) AS distinct_after,
  {R('(SELECT AVG(amount) FROM fx_dirty)', 3)} AS mean_before, {R('(SELECT AVG(amount) FROM a)', 3)} AS mean_after,
  {R('(SELECT MEDIAN(amount) FROM fx_dirty)', 3)} AS median_before, {R('(SELECT MEDIAN(amount) FROM a)', 3)} AS median_after,
  {R('(SELECT AVG(amount) FROM a) - (SELECT AVG(amount) FROM fx_dirty)', 3)} AS mean_diff""")
def cmp_before_after(spark, sf):
    d = view(spark, sf, "fx_dirty").select("id", "copy", "amount", "cat", "num_text")
    stat = lambda x: P.field_report(x.select("amount"))
    got = V.compare_stats(stat(d), stat(_cleaned(d).data))
    return plain(got.select("field", *[f"{c}_{w}" for c in ("null_rate", "distinct") for w in ("before", "after")],
                            *[F.round(f"{c}_{w}", 3).alias(f"{c}_{w}") for c in ("mean", "median") for w in ("before", "after")], F.round("mean_diff", 3).alias("mean_diff")))


@query("chk_required_fields", f"""
SELECT * FROM (SELECT 'amount' AS field, {R('AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_rate FROM fx_dirty
UNION ALL SELECT 'cat', {R('AVG(CASE WHEN cat IS NULL THEN 1.0 ELSE 0.0 END)')} FROM fx_dirty
UNION ALL SELECT 'id', {R('AVG(CASE WHEN id IS NULL THEN 1.0 ELSE 0.0 END)')} FROM fx_dirty) WHERE null_rate > 0""")
def chk_required_fields(spark, sf):
    return plain(V.required_nulls(view(spark, sf, "fx_dirty"), ["id", "amount", "cat"]))


@query("recommend", f"""
WITH {AFTER}, n AS (SELECT COUNT(*) AS b FROM fx_dirty), m AS (SELECT COUNT(*) AS c FROM a)
SELECT 'P1' AS severity, 'many rows removed' AS item, {R('(b - c) * 1.0 / b')} AS evidence FROM n, m WHERE (b - c) * 1.0 / b > 0.02
UNION ALL SELECT 'P0', 'failed: id unique', {R('(SELECT COUNT(*) - COUNT(DISTINCT id) FROM a)')} WHERE (SELECT COUNT(*) - COUNT(DISTINCT id) FROM a) > 0
UNION ALL SELECT 'P0', 'still null: lat2', {R('AVG(CASE WHEN lat > 90 THEN 1.0 ELSE 0.0 END)')} FROM fx_dirty WHERE amount IS NOT NULL HAVING AVG(CASE WHEN lat > 90 THEN 1.0 ELSE 0.0 END) > 0
UNION ALL SELECT 'P1', 'mostly filled: cat', {R('(SELECT COUNT(*) FROM fx_dirty WHERE amount IS NOT NULL AND cat IS NULL) * 1.0 / c')} FROM m WHERE (SELECT COUNT(*) FROM fx_dirty WHERE amount IS NOT NULL AND cat IS NULL) * 1.0 / c > 0.02
UNION ALL SELECT 'P2', 'outliers left: amount', {R('n')} FROM oa WHERE n > 0""")
def recommend(spark, sf):
    d = view(spark, sf, "fx_dirty")
    got = _cleaned(d)
    data = got.data.withColumn("lat2", F.when(~(F.col("lat") > 90), F.col("lat")))
    report = V.validate(data, [{"name": "id unique", "check": "unique", "field": "id", "severity": "P0"}])
    rows = data.count()
    fills = got.log.filter("action = 'fill'").select("field", (F.col("affected_rows") / F.lit(rows)).alias("fill_rate"))
    left = P.outlier_summary(P.outliers(data, "id", "iqr", 0.5, ["amount"]), 1).select("field", F.lit("required").alias("level"), "outliers")
    return plain(V.recommendations(got.stats, report, V.required_nulls(data, ["lat2", "amount"]), fills, left, 0.02, 0.02))


@query("chk_id_renumbered", f"""
WITH e AS (SELECT entity, arg_min(n_orders, year) AS f, arg_max(n_orders, year) AS l FROM fx_panel GROUP BY entity)
SELECT {R('AVG(CASE WHEN f <> l THEN 1.0 ELSE 0.0 END)')} AS share,
  {R('AVG(CASE WHEN d.acq_year IS NOT NULL THEN CASE WHEN f <> l THEN 1.0 ELSE 0.0 END END)')} AS share_closed FROM e JOIN fx_dim d ON d.entity = e.entity""")
def chk_id_renumbered(spark, sf):
    from geostrata.operators.panel import dim_last_row

    e = dim_last_row(view(spark, sf, "fx_panel"), "entity", "year", ["n_orders"], ["n_orders"])
    j = e.join(view(spark, sf, "fx_dim").select("entity", "acq_year"), "entity")
    return plain(V.renumbered_share(j, "n_orders_first", "n_orders_last", F.col("acq_year").isNotNull()))


@query("chk_vocab_share", f"""
SELECT UPPER(TRIM(c_mktsegment)) AS code, {L('COUNT(*)')} AS n, {R('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM customer)')} AS share,
  {L("MAX(CASE WHEN UPPER(TRIM(c_mktsegment)) IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END)")} AS known FROM customer GROUP BY 1""")
def chk_vocab_share(spark, sf):
    return plain(V.vocabulary_share(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]))


@query("chk_control_coverage", f"""
WITH r AS (SELECT region, SUM(CASE WHEN acq_year IS NULL AND last_year >= 2001 THEN 1 ELSE 0 END) AS alive, SUM(CASE WHEN acq_year IS NOT NULL THEN 1 ELSE 0 END) AS closed FROM fx_dim GROUP BY region)
SELECT {L('SUM(closed)')} AS events, {R('SUM(CASE WHEN alive > 0 THEN closed ELSE 0 END) * 1.0 / SUM(closed)')} AS coverage FROM r""")
def chk_control_coverage(spark, sf):
    closed = F.col("acq_year").isNotNull()
    return plain(V.control_coverage(view(spark, sf, "fx_dim"), "region", closed, ~closed & (F.col("last_year") >= 2001)))


LIFE = {"chk_death_after_birth": "death_before_birth", "chk_censored_ratio": "censored_ratio", "chk_event_within_window": "event_before_window"}


def _life(name, column):
    exprs = {
        "death_before_birth": L("SUM(CASE WHEN acq_year < est_year THEN 1 ELSE 0 END)"),
        "censored_ratio": R("AVG(CASE WHEN acq_year IS NULL THEN 1.0 ELSE 0.0 END)"),
        "event_before_window": L("SUM(CASE WHEN acq_year < first_year THEN 1 ELSE 0 END)"),
    }

    @query(name, f"SELECT {exprs[column]} AS {column} FROM fx_dim")
    def run(spark, sf):
        return plain(V.life_checks(view(spark, sf, "fx_dim"), "est_year", "acq_year", "first_year").select(column))


for _n, _c in LIFE.items():
    _life(_n, _c)


@query("parallel_trend_prep", f"""
WITH p AS (SELECT *, LAG(value) OVER (PARTITION BY entity ORDER BY year) AS prev FROM fx_panel),
g AS (SELECT p.*, CASE WHEN prev IS NULL OR prev = 0 THEN NULL ELSE LEAST(GREATEST((value - prev) / prev, -0.5), 0.5) END AS rate,
  CASE WHEN d.acq_year IS NOT NULL THEN 'closed' WHEN d.last_year >= 2001 THEN 'alive' ELSE 'attrition' END AS et, d.last_year FROM p JOIN fx_dim d ON d.entity = p.entity)
SELECT {R("AVG(CASE WHEN et = 'closed' AND year <= last_year - 1 THEN rate END)")} AS treated_mean, {R("AVG(CASE WHEN et = 'alive' THEN rate END)")} AS control_mean,
  {R("AVG(CASE WHEN et = 'closed' AND year <= last_year - 1 THEN rate END) - AVG(CASE WHEN et = 'alive' THEN rate END)")} AS gap,
  {R("MEDIAN(CASE WHEN et = 'closed' AND year <= last_year - 1 THEN rate END)")} AS treated_median, {R("MEDIAN(CASE WHEN et = 'alive' THEN rate END)")} AS control_median FROM g""")
def parallel_trend_prep(spark, sf):
    from geostrata.operators.panel import event_type, parallel_trend

    dim = view(spark, sf, "fx_dim").withColumn("event_type", event_type("acq_year", "last_year", 2001))
    return plain(parallel_trend(view(spark, sf, "fx_panel"), dim, "entity", "year", "value"))


@query("chk_custom", f"""
SELECT 'late_years' AS name, CASE WHEN COUNT(*) = 0 THEN 'pass' ELSE 'fail' END AS status, COUNT(*) || ' rows' AS message FROM fx_dirty WHERE year > 2000
UNION ALL SELECT 'more_prices_than_gaps', CASE WHEN COUNT(amount) > COUNT(*) - COUNT(amount) THEN 'pass' ELSE 'fail' END, COUNT(amount) || ' of ' || COUNT(*) FROM fx_dirty
UNION ALL SELECT 'broken', 'fail', 'no such table for ' || COUNT(DISTINCT cat) || ' categories' FROM fx_dirty""")
def chk_custom(spark, sf):
    def late_years(df):
        n = df.filter("year > 2000").count()
        return n == 0, f"{n} rows"

    def more_prices_than_gaps(df):
        held, n = df.agg(F.count("amount"), F.count("*")).first()
        return held > n - held, f"{held} of {n}"

    def broken(df):
        raise ValueError(f"no such table for {df.select('cat').filter('cat is not null').distinct().count()} categories")

    return V.validate(view(spark, sf, "fx_dirty"), [late_years, more_prices_than_gaps, broken]).select("name", "status", "message")


@query("reconcile", f"""
WITH l AS (SELECT entity, year, value, n_orders FROM fx_panel),
r AS (SELECT entity, year, CASE WHEN entity % 97 = 0 THEN NULL ELSE value + CASE WHEN entity % 89 = 0 THEN 0.5 ELSE 0 END END AS value, n_orders FROM fx_panel WHERE year > 1995),
j AS (SELECT l.entity AS le, r.entity AS re, l.value AS lv, r.value AS rv, l.n_orders AS ln, r.n_orders AS rn FROM l FULL OUTER JOIN r ON l.entity = r.entity AND l.year = r.year)
SELECT 'value' AS field, {L('COUNT(le)')} AS rows_left, {L('COUNT(re)')} AS rows_right, {L('COUNT(CASE WHEN le IS NOT NULL AND re IS NOT NULL THEN 1 END)')} AS rows_both,
  {L('COUNT(CASE WHEN le IS NOT NULL AND re IS NOT NULL AND (lv IS NULL) <> (rv IS NULL) THEN 1 END)')} AS null_mismatch, {R('MAX(ABS(lv - rv))')} AS max_diff, CAST(0 AS BIGINT) AS ok FROM j
UNION ALL SELECT 'n_orders', {L('COUNT(le)')}, {L('COUNT(re)')}, {L('COUNT(CASE WHEN le IS NOT NULL AND re IS NOT NULL THEN 1 END)')},
  CAST(0 AS BIGINT), {R('MAX(ABS(ln - rn))')}, CAST(0 AS BIGINT) FROM j""")
def reconcile(spark, sf):
    left = view(spark, sf, "fx_panel")
    shifted = F.when(F.col("entity") % 97 != 0, F.col("value") + F.when(F.col("entity") % 89 == 0, 0.5).otherwise(0.0))
    return plain(V.reconcile(left, left.filter("year > 1995").withColumn("value", shifted), ["entity", "year"], ["value", "n_orders"]))


@query("lock_drift", """
WITH a AS (SELECT o_orderstatus AS k, CAST(COUNT(*) AS VARCHAR) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1),
b AS (SELECT o_orderstatus AS k, CAST(COUNT(*) AS VARCHAR) AS v FROM orders GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS fact, a.v AS stored, b.v AS current FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def lock_drift(spark, sf):
    o = table(spark, sf, "orders")
    facts = lambda d: d.groupBy(F.col("o_orderstatus").alias("fact")).agg(F.count("*").alias("rows"))
    return V.fact_drift(facts(o.filter("o_orderdate < '2000-01-01'")), facts(o), "fact", "rows")
