"""Column profiles and outliers."""

from pyspark.sql import functions as F

from geostrata.operators import profile as P
from geostrata.operators import sketches as S
from geostrata.operators.schema import FieldSpec, Rule, violations
from geostrata.queries.registry import L, R, plain, query, table, view
from geostrata.session import scratch_path

NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, {R(f'MIN({c})')} AS min, {R(f'MAX({c})')} AS max, {R(f'AVG({c})')} AS mean,
    {R(f'STDDEV_POP({c})', 4)} AS std, {R(f'MEDIAN({c})')} AS median, {R(f'QUANTILE_CONT({c}, 0.01)')} AS q01,
    {R(f'QUANTILE_CONT({c}, 0.25)')} AS q25, {R(f'QUANTILE_CONT({c}, 0.75)')} AS q75, {R(f'QUANTILE_CONT({c}, 0.99)')} AS q99,
    {R(f'AVG(CASE WHEN {c} < 0 THEN 1.0 WHEN {c} >= 0 THEN 0.0 END)')} AS negative_rate,
    {R(f'AVG(CASE WHEN {c} = 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)')} AS zero_rate FROM fx_dirty"""
    for c in ("amount", "lat")
)


@query("prof_numeric", NUMERIC_SQL)
def prof_numeric(spark, sf):
    s = P.numeric_stats(view(spark, sf, "fx_dirty"), ["amount", "lat"]).withColumn("std", F.round("std", 4))
    keep = ("field", "min", "max", "mean", "std", "median", "q01", "q25", "q75", "q99", "negative_rate", "zero_rate")
    return plain(s.select(*keep))


@query("prof_datetime", """
SELECT 'o_orderdate' AS field, strftime(MIN(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min,
       strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max FROM orders""")
def prof_datetime(spark, sf):
    return P.datetime_range(table(spark, sf, "orders"), ["o_orderdate"])


@query("prof_topn", f"""
WITH c AS (SELECT 'cat' AS field, cat AS value, COUNT(*) AS n FROM fx_dirty WHERE cat IS NOT NULL GROUP BY cat
  UNION ALL SELECT 'num_text', num_text, COUNT(*) FROM fx_dirty GROUP BY num_text),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, value, {L('n')} AS n, {L('rank')} AS rank FROM r WHERE rank <= 10""")
def prof_topn(spark, sf):
    return plain(P.top_values(view(spark, sf, "fx_dirty"), ["cat", "num_text"], 10))


@query("prof_sketch", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, {L('COUNT(*)')} AS rows, {L(f'COUNT({c})')} AS non_null, {L(f'COUNT(*) - COUNT({c})')} AS null_count, {R(f'MIN({c})')} AS min, {R(f'MAX({c})')} AS max,
    {R(f'AVG({c})', 3)} AS mean, {R(f'STDDEV_POP({c})', 3)} AS std, {d} AS "distinct" FROM fx_dirty"""
    for c, d in (("amount", L("0")), ("lat", L("COUNT(DISTINCT lat)")), ("year", L("COUNT(DISTINCT year)")))))
def prof_sketch(spark, sf):
    """Years arrive in two lots; the second lot's profile is merged with the stored one of the first."""
    d = view(spark, sf, "fx_dirty").select("amount", "lat", "year", F.col("year").alias("part"))
    store, names = scratch_path(spark, "sketches"), sorted(str(r[0]) for r in d.select("part").distinct().collect())
    read = lambda some: d.filter(F.col("part").cast("string").isin(some))
    for lot in (names[:len(names) // 2], names):
        S.update(spark, store, lot, read, "part")
    got = S.summary(S.merged(S.stored(spark, store))).withColumn("distinct", F.when(F.col("field") != "amount", F.col("distinct")).otherwise(0))  # exact for few values only
    return plain(got.select("field", "rows", "non_null", "null_count", "min", "max", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "distinct"))


COUNT_COLS = ("id", "entity", "year", "amount", "cat", "lat", "num_text")


@query("prof_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {L('COUNT(*)')} AS count, {L(f'COUNT({c})')} AS non_null, {L(f'COUNT(*) - COUNT({c})')} AS null_count, "
    f"{R(f'(COUNT(*) - COUNT({c})) * 1.0 / COUNT(*)')} AS null_rate, {L(f'COUNT(DISTINCT {c})')} AS \"distinct\" FROM fx_dirty"
    for c in COUNT_COLS))
def prof_counts(spark, sf):
    return plain(P.column_counts(view(spark, sf, "fx_dirty").select(*COUNT_COLS)).drop("dtype", "role"))


IQR = """b AS (SELECT QUANTILE_CONT(amount, 0.25) AS q1, QUANTILE_CONT(amount, 0.75) AS q3 FROM fx_dirty),
o AS (SELECT id, copy, amount, q1 - {t} * (q3 - q1) AS lo, q3 + {t} * (q3 - q1) AS hi FROM fx_dirty, b
      WHERE amount < q1 - {t} * (q3 - q1) OR amount > q3 + {t} * (q3 - q1))"""


@query("prof_summary", f"""
WITH {IQR.format(t=0.5)}
SELECT {L('COUNT(*)')} AS rows, CAST(2 AS BIGINT) AS columns, {L('COUNT(*) - COUNT(amount)')} AS null_cells,
       {R('(COUNT(*) - COUNT(amount)) / (COUNT(*) * 2.0)')} AS null_rate, (SELECT {L('COUNT(*)')} FROM o) AS outlier_count
FROM fx_dirty""")
def prof_summary(spark, sf):
    d = view(spark, sf, "fx_dirty").select("id", "amount")
    return plain(P.profile_summary(d, P.outliers(d, "id", "iqr", 0.5)))


@query("prof_nulls", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {L(f'COUNT(*) - COUNT({c})')} AS null_count, {R(f'(COUNT(*) - COUNT({c})) * 1.0 / COUNT(*)')} AS null_rate, "
    f"'{r}' AS role, '{m}' AS meaning FROM fx_dirty"
    for c, r, m in (("id", "key", "defect"), ("cat", "categorical", "recode to unknown"), ("amount", "numeric", "fill or flag"), ("lat", "spatial", "needs handling"))))
def prof_nulls(spark, sf):
    return plain(P.null_table(view(spark, sf, "fx_dirty").select("id", "cat", "amount", "lat"), {"cat": "categorical"}))


def _outlier_rows(df):
    return plain(df.select("field", "row_id", "value", "method", "lower_bound", "upper_bound"))


@query("outlier_iqr", f"""
WITH {IQR.format(t=0.5)}
SELECT 'amount' AS field, {L('id')} AS row_id, {R('amount')} AS value, 'iqr' AS method, {R('lo')} AS lower_bound, {R('hi')} AS upper_bound FROM o""")
def outlier_iqr(spark, sf):
    return _outlier_rows(P.outliers(view(spark, sf, "fx_dirty"), "id", "iqr", 0.5, ["amount"]))


@query("outlier_zscore", f"""
WITH b AS (SELECT AVG(amount) AS m, STDDEV_POP(amount) AS s FROM fx_dirty)
SELECT 'amount' AS field, {L('id')} AS row_id, {R('amount')} AS value, 'zscore' AS method,
       CAST(-1.5 AS DOUBLE) AS lower_bound, CAST(1.5 AS DOUBLE) AS upper_bound
FROM fx_dirty, b WHERE ABS((amount - m) / s) > 1.5""")
def outlier_zscore(spark, sf):
    return _outlier_rows(P.outliers(view(spark, sf, "fx_dirty"), "id", "zscore", 1.5, ["amount"]))


@query("outlier_mad", f"""
WITH b AS (SELECT MEDIAN(amount) AS m FROM fx_dirty),
d AS (SELECT MEDIAN(ABS(amount - m)) AS mad FROM fx_dirty, b)
SELECT 'amount' AS field, {L('id')} AS row_id, {R('amount')} AS value, 'mad' AS method,
       CAST(-1.25 AS DOUBLE) AS lower_bound, CAST(1.25 AS DOUBLE) AS upper_bound
FROM fx_dirty, b, d WHERE ABS(0.6745 * (amount - m) / mad) > 1.25""")
def outlier_mad(spark, sf):
    return _outlier_rows(P.outliers(view(spark, sf, "fx_dirty"), "id", "mad", 1.25, ["amount"]))


@query("outlier_summary", f"""
WITH {IQR.format(t=0.5)}
SELECT 'amount' AS field, {L('COUNT(*)')} AS outliers, {R('MIN(lo)')} AS lower_bound, {R('MIN(hi)')} AS upper_bound,
       {R('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM fx_dirty)')} AS rate FROM o""")
def outlier_summary(spark, sf):
    d = view(spark, sf, "fx_dirty")
    return plain(P.outlier_summary(P.outliers(d, "id", "iqr", 0.5, ["amount"]), d.count()))


@query("outlier_topn", f"""
WITH {IQR.format(t=0.5)}, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM o WHERE copy = 0)
SELECT 'amount' AS field, {L('id')} AS row_id, {R('amount')} AS value FROM r WHERE rn <= 20""")
def outlier_topn(spark, sf):
    d = view(spark, sf, "fx_dirty")
    bounds = P.outliers(d, "id", "iqr", 0.5, ["amount"])
    first = d.filter("copy = 0").select("id", "amount")
    only_first = bounds.join(first, (F.col("row_id") == F.col("id")) & (F.col("value") == F.col("amount")), "left_semi")
    return plain(P.outlier_first_rows(only_first, 20).select("field", "row_id", "value"))


SPECS = (
    FieldSpec("amount", "numeric", "required", rules=(Rule("not_null"), Rule("non_negative"))),
    FieldSpec("cat", "categorical", "important"),
    FieldSpec("lat", "spatial", "optional", rules=(Rule("geo_lat"),)),
)


@query("prof_issue_count", f"""
WITH {IQR.format(t=0.5)}
SELECT 'amount' AS field, {L("CASE WHEN COUNT(*) > COUNT(amount) THEN 1 ELSE 0 END + CASE WHEN (SELECT COUNT(*) FROM o) > 0 THEN 1 ELSE 0 END + CASE WHEN SUM(CASE WHEN amount < 0 OR amount IS NULL THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END")} AS n_issues FROM fx_dirty
UNION ALL SELECT 'cat', {L("CASE WHEN COUNT(*) > COUNT(cat) THEN 1 ELSE 0 END")} FROM fx_dirty
UNION ALL SELECT 'lat', {L("CASE WHEN COUNT(*) > COUNT(lat) THEN 1 ELSE 0 END + CASE WHEN SUM(CASE WHEN lat > 90 OR lat < -90 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END")} FROM fx_dirty""")
def prof_issue_count(spark, sf):
    d = view(spark, sf, "fx_dirty")
    outs = P.outlier_summary(P.outliers(d, "id", "iqr", 0.5, ["amount"]), 1)
    return plain(P.issue_counts(P.null_table(d.select("amount", "cat", "lat")), outs, violations(d, SPECS)))


@query("prof_level_dist", f"""
WITH f AS (SELECT CASE WHEN n < 2000000000 AND c = 'amount' THEN 'required' WHEN c = 'cat' THEN 'important' ELSE 'optional' END AS level
  FROM (SELECT 'amount' AS c, COUNT(amount) AS n FROM fx_dirty UNION ALL SELECT 'cat', COUNT(cat) FROM fx_dirty
        UNION ALL SELECT 'lat', COUNT(lat) FROM fx_dirty UNION ALL SELECT 'id', COUNT(id) FROM fx_dirty))
SELECT level, {L('COUNT(*)')} AS fields FROM f GROUP BY level""")
def prof_level_dist(spark, sf):
    d = view(spark, sf, "fx_dirty").select("amount", "cat", "lat", "id")
    levels = {s.name: s.level for s in SPECS}
    pairs = [F.lit(x) for c in d.columns for x in (c, levels.get(c, "optional"))]
    found = P.column_counts(d).select(F.create_map(*pairs)[F.col("field")].alias("level"))
    return plain(found.groupBy("level").agg(F.count("*").alias("fields")))


@query("prof_key_findings", f"""
WITH f AS (SELECT entity, COUNT(*) AS n FROM fx_dirty WHERE year = (SELECT MIN(year) FROM fx_dirty) GROUP BY entity),
c AS (SELECT entity, MAX(cat) <> MIN(cat) AS ch FROM fx_dirty GROUP BY entity)
SELECT (SELECT {L('SUM(n - 1)')} FROM f) AS first_year_duplicates,
       (SELECT {R('AVG(CASE WHEN ch THEN 1.0 ELSE 0.0 END)')} FROM c) AS changed_share,
       {R('AVG(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_amount,
       {R('AVG(CASE WHEN cat IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_cat FROM fx_dirty""")
def prof_key_findings(spark, sf):
    return plain(P.key_findings(view(spark, sf, "fx_dirty"), "entity", "year", "cat", ["amount", "cat"]))


@query("field_report", f"""
WITH t AS (SELECT cat AS v, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, cat) AS r FROM fx_dirty WHERE cat IS NOT NULL GROUP BY cat)
SELECT 'amount' AS field, {L('COUNT(amount)')} AS non_null, {L('COUNT(DISTINCT amount)')} AS "distinct", {R('MIN(amount)')} AS min,
  {R('MAX(amount)')} AS max, {R('AVG(amount)')} AS mean, {R('MEDIAN(amount)')} AS median, CAST(NULL AS VARCHAR) AS top FROM fx_dirty
UNION ALL SELECT 'cat', {L('COUNT(cat)')}, {L('COUNT(DISTINCT cat)')}, NULL, NULL, NULL, NULL,
  (SELECT STRING_AGG(v, '|' ORDER BY r) FROM t WHERE r <= 5) FROM fx_dirty""")
def field_report(spark, sf):
    d = P.field_report(view(spark, sf, "fx_dirty").select("amount", "cat"))
    return plain(d.select("field", "non_null", "distinct", "min", "max", "mean", "median", "top"))
