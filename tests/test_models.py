import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.functions import tails
from geostrata.functions.columns import nan_to_null
from geostrata.operators import evaluate as E
from geostrata.operators import hazard as H
from geostrata.operators import moran as M
from geostrata.operators import spatial_reg as S
from geostrata.operators import twfe as T
from geostrata.operators import weights as W
from geostrata.operators.linear import ols


def panel(seed=2, n=40, years=8):
    rng = np.random.default_rng(seed)
    e, t = np.meshgrid(np.arange(n), np.arange(2000, 2000 + years), indexing="ij")
    d = pd.DataFrame({"e": e.ravel(), "t": t.ravel()})
    d = d[rng.random(len(d)) < 0.8].reset_index(drop=True)  # unbalanced
    d["first_event_year"] = np.where(d["e"] % 3 == 0, 2003 + d["e"] % 2, 0)
    d["strength_t0"] = np.where(d["first_event_year"] > 0, 0.5 + (d["e"] % 5) / 4, 0.0)
    d["post"] = ((d["first_event_year"] > 0) & (d["t"] >= d["first_event_year"])).astype(int)
    d["rate"] = rng.normal(size=len(d)) * 0.1 + d["e"] * 0.005 - (d["t"] - 2000) * 0.02 - 0.05 * d["post"]
    return d


def dummies(d, xs):
    parts = [d[xs].to_numpy(float), pd.get_dummies(d["e"]).to_numpy(float), pd.get_dummies(d["t"]).to_numpy(float)[:, 1:]]
    return np.column_stack(parts)


def clustered(d, y, xs, dof_k):
    full = dummies(d, xs)
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    fe = full[:, len(xs):]
    x = d[xs].to_numpy(float)
    xd = x - fe @ np.linalg.lstsq(fe, x, rcond=None)[0]
    r = y - full @ beta
    inv = np.linalg.inv(xd.T @ xd)
    meat = np.zeros((len(xs), len(xs)))
    for _, i in d.groupby("e").indices.items():
        u = xd[i].T @ r[i]
        meat += np.outer(u, u)
    g, n = d["e"].nunique(), len(d)
    return beta[: len(xs)], np.sqrt(np.diag(inv @ meat @ inv) * g / (g - 1) * (n - 1) / (n - dof_k))


def sample(d):
    tau = d["t"] - d["first_event_year"]
    s = d[(d["first_event_year"] <= 0) | tau.between(-3, 4)].reset_index(drop=True)
    return s.assign(y=s["rate"].clip(-0.5, 0.5), px=s["post"] * s["strength_t0"], p=s["post"].astype(float))


def test_twfe_exact_equals_dummy_regression(spark):
    d = panel()
    fit = T.twfe(spark.createDataFrame(d), "rate", "e", "t", method="exact")
    s = sample(d)
    beta, se = clustered(s, s["y"].to_numpy(), ["px", "p"], 2)
    np.testing.assert_allclose(fit.beta, beta, atol=1e-9)
    np.testing.assert_allclose(fit.se, se, atol=1e-9)
    assert fit.n == len(s) and fit.extra["n_entities"] == s["e"].nunique()


def test_event_study_exact_and_baseline(spark):
    d = panel()
    rows, stats = T.event_study(spark.createDataFrame(d), "rate", "e", "t", method="exact")
    s = sample(d)
    tau = np.where(s["first_event_year"] > 0, s["t"] - s["first_event_year"], 99)
    names = []
    for r in (-3, -2, 0, 1, 2, 3, 4):
        s[f"x{r}"] = (tau == r).astype(float)
        names.append(f"x{r}")
    beta, se = clustered(s, s["y"].to_numpy(), names, len(names))
    got = {r[0]: r for r in rows}
    assert got[-1][1:] == (0.0, 0.0, 1.0)
    for name, b, e in zip(names, beta, se):
        assert got[int(name[1:])][1] == pytest.approx(b, abs=1e-9)
        assert got[int(name[1:])][2] == pytest.approx(e, abs=1e-9)
    assert stats["pre_trend_max_abs_t"] == pytest.approx(max(abs(beta[0] / se[0]), abs(beta[1] / se[1])))


def test_one_pass_demeaning_is_exact_when_balanced(spark):
    d = pd.DataFrame([(e, t, float((e * 7 + t * 3) % 11)) for e in range(6) for t in range(5)], columns=["e", "t", "v"])
    df = spark.createDataFrame(d)
    a, b = (T.demean(df, ["v"], "e", "t", m).orderBy("e", "t").toPandas()["v"] for m in ("one_pass", "exact"))
    np.testing.assert_allclose(a, b, atol=1e-10)


def test_marginal_effect_is_zero_at_the_crossing(spark):
    c = spark.createDataFrame([(-0.05, 0.01, 0.0125, 0.002)], "b0 double, se0 double, b1 double, se1 double")
    rows = T.marginal_effect(c).collect()
    at = {round(r["s"], 3): r for r in rows}
    assert len(rows) == 41 and at[4.0]["effect"] == pytest.approx(0.0, abs=1e-12) and at[0.0]["zero_crossing"] == pytest.approx(4.0)
    assert all(r["worst_lo"] <= r["ci_lo"] <= r["effect"] <= r["ci_hi"] <= r["worst_hi"] for r in rows)


# --- spatial -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(4)
    n = 150
    p = pd.DataFrame({"id": np.arange(n), "lat": rng.random(n), "lng": rng.random(n), "x": rng.normal(size=n)})
    df = spark.createDataFrame(p)
    edges = W.knn_weights(df, 5).toPandas()
    w = np.zeros((n, n))
    w[edges["src"], edges["dst"]] = edges["w"]
    noise = rng.normal(size=n) * 0.3
    lam = np.linalg.solve(np.eye(n) - 0.6 * w, noise)
    p["y_lag"] = np.linalg.solve(np.eye(n) - 0.5 * w, 1 + 2 * p["x"] + noise)
    p["y_err"] = 1 + 2 * p["x"] + lam
    p["u"] = lam
    return p, spark.createDataFrame(p), spark.createDataFrame(edges), w


def test_ols_and_slx(space):
    p, df, edges, w = space
    x = np.column_stack([np.ones(len(p)), p["x"], w @ p["x"]])
    beta = np.linalg.lstsq(x, p["y_lag"], rcond=None)[0]
    r = p["y_lag"] - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (r @ r) / (len(p) - 3))
    fit = S.slx(df, edges, "y_lag", ["x"])
    np.testing.assert_allclose(fit.beta, beta, atol=1e-9)
    np.testing.assert_allclose(fit.se, se, atol=1e-9)
    assert fit.extra["r2"] == pytest.approx(1 - r @ r / ((p["y_lag"] - p["y_lag"].mean()) ** 2).sum())
    one = ols(df, "y_lag", ["x"])
    np.testing.assert_allclose(one.beta, np.linalg.lstsq(x[:, :2], p["y_lag"], rcond=None)[0], atol=1e-9)


def test_lm_tests_equal_dense_algebra(space):
    p, df, edges, w = space
    n, y = len(p), p["y_lag"].to_numpy()
    x = np.column_stack([np.ones(n), p["x"]])
    inv = np.linalg.inv(x.T @ x)
    m = np.eye(n) - x @ inv @ x.T
    e = m @ y
    s2, tr = e @ e / n, np.trace(w.T @ w + w @ w)
    wxb = w @ (y - e)
    nj = wxb @ m @ wxb / s2 + tr
    dl, de = e @ w @ y / s2, e @ w @ e / s2
    want = {"lm_lag": dl**2 / nj, "lm_error": de**2 / tr, "robust_lag": (dl - de) ** 2 / (nj - tr), "robust_error": (de - tr / nj * dl) ** 2 / (tr * (1 - tr / nj))}
    got = S.lm_tests(df, edges, "y_lag", ["x"])
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-8)
        assert got[f"{k}_p"] == pytest.approx(math.erfc(math.sqrt(v / 2)))
    sigma2 = e @ e / (n - 2)
    ref = S.lm_tests(df, edges, "y_lag", ["x"], form="reference")
    mwy = m @ w @ y
    assert ref["lm_lag"] == pytest.approx((e @ w @ y) ** 2 / (mwy @ mwy), rel=1e-8)
    assert ref["lm_error"] == pytest.approx((e @ w @ e) ** 2 / (((w @ e) @ (w @ e)) * (n - 2)), rel=1e-8)
    assert sigma2 > 0 and S.choose_model(got) in ("lag", "error", "sdm", "ols")


def test_two_stage_lag_model(space):
    p, df, edges, w = space
    n, y = len(p), p["y_lag"].to_numpy()
    z = np.column_stack([np.ones(n), p["x"], w @ y])
    h = np.column_stack([np.ones(n), p["x"], w @ p["x"]])
    ph = h @ np.linalg.inv(h.T @ h) @ h.T
    beta = np.linalg.solve(z.T @ ph @ z, z.T @ ph @ y)
    r = y - z @ beta
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ ph @ z)) * (r @ r) / n)
    fit = S.sar_2sls(df, edges, "y_lag", ["x"])
    np.testing.assert_allclose(fit.beta, beta, atol=1e-7)
    np.testing.assert_allclose(fit.se, se, atol=1e-7)
    assert abs(fit.extra["rho"] - 0.5) < 0.15
    eff = S.split_effects({"sar": fit}, "x")[0]
    rho, b = beta[2], beta[1]
    assert eff["total"] == pytest.approx(b / (1 - rho) + b * rho / (1 - rho) ** 2)


def test_error_model_recovers_lambda(space):
    _, df, edges, _ = space
    fit = S.sem_gmm(df, edges, "y_err", ["x"])
    assert abs(fit.extra["lambda"] - 0.6) < 0.25 and abs(fit.coef("x") - 2) < 0.1


def test_moran_inference_and_permutation(space):
    p, df, edges, w = space
    n = len(p)
    z = (p["u"] - p["u"].mean()).to_numpy()
    i = z @ w @ z / (z @ z)
    assert M.moran(df, edges, "u").first()["moran_i"] == pytest.approx(i)
    s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    e = -1 / (n - 1)
    vn = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    got = M.moran_inference(df, edges, "u").first()
    assert got["var_norm"] == pytest.approx(vn) and got["z_norm"] == pytest.approx((i - e) / math.sqrt(vn))
    strong = M.moran_permutation(df, edges, "u", permutations=39).first()
    assert strong["moran_i"] == pytest.approx(i) and strong["p_value"] == pytest.approx(1 / 40)
    weak = M.moran_permutation(df, edges, "x", permutations=39).first()
    assert weak["p_value"] > 0.05
    assert M.moran_permutation(df.limit(5), edges, "x", min_nodes=10).first()["moran_i"] is None


def test_islands_keep_their_row(spark):
    nodes = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 9.0)], "id long, v double")
    w = W.row_standardised(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    got = {r["id"]: r["lag"] for r in W.spatial_lag(nodes, w, {"lag": "v"}).collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 0.0}
    s = W.weights_summary(nodes, w).first()
    assert (s["n"], s["islands"], s["bad_rows"]) == (3, 1, 0)


# --- hazards and evaluation --------------------------------------------------------------------


@pytest.fixture(scope="module")
def risk(spark):
    rng = np.random.default_rng(9)
    n = 1500
    d = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "g": rng.choice(["a", "b", "c"], n), "t": rng.integers(1, 13, n)})
    eta = -1 + 0.8 * d["x"] + d["g"].map({"a": 0.0, "b": 0.4, "c": -0.3})
    d["event"] = (rng.random(n) < 1 - np.exp(-np.exp(eta))).astype(int)
    d["score"] = (1 / (1 + np.exp(-eta))).round(2)
    return d, spark.createDataFrame(d)


def test_cloglog_equals_newton(risk):
    d, df = risk
    x = np.column_stack([d["x"], d["g"] == "b", d["g"] == "c", np.ones(len(d))]).astype(float)
    y, beta = d["event"].to_numpy(float), np.zeros(4)
    for _ in range(60):
        eta = x @ beta
        mu = 1 - np.exp(-np.exp(eta))
        dmu = np.exp(eta - np.exp(eta))
        wt = dmu**2 / (mu * (1 - mu))
        beta = np.linalg.solve(x.T @ (x * wt[:, None]), x.T @ (wt * (eta + (y - mu) / dmu)))
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * wt[:, None]))))
    fit = H.fit_cloglog(df, "event", ["x"], ["g"])
    np.testing.assert_allclose([*fit.coefs, fit.intercept], beta, atol=1e-5)
    np.testing.assert_allclose([r[4] for r in fit.rows], se, atol=1e-4)
    ll = lambda m: np.sum(y * np.log(m) + (1 - y) * np.log(1 - m))
    assert fit.stats["pseudo_r2"] == pytest.approx(1 - ll(mu) / ll(np.full(len(y), y.mean())), abs=1e-5)


def test_logit_ranks_like_the_truth(risk):
    _, df = risk
    fit = H.fit_logit(df, "event", ["x"], ["g"])
    assert fit.coefs[0] > 0 and fit.coefs[1] > 0 > fit.coefs[2]
    assert E.auc(fit.predict(df), "event", "risk").first()[0] > 0.65


def test_auc_brier_and_c_index(risk):
    d, df = risk
    pos, neg = d.loc[d["event"] == 1, "score"].to_numpy(), d.loc[d["event"] == 0, "score"].to_numpy()
    gap = pos[:, None] - neg
    assert E.auc(df, "event", "score").first()[0] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())
    assert E.brier(df, "event", "score").first()[0] == pytest.approx(((d["score"] - d["event"]) ** 2).mean())
    t, s, e = (d[c].to_numpy() for c in ("t", "score", "event"))
    pairs = (e[:, None] == 1) & (t > t[:, None])
    lower, same = s < s[:, None], s == s[:, None]
    assert E.c_index(df, "score", "t", "event").first()[0] == pytest.approx((pairs & lower).sum() / pairs.sum())
    assert E.c_index(df, "score", "t", "event", "half").first()[0] == pytest.approx(((pairs & lower).sum() + (pairs & same).sum() / 2) / pairs.sum())
    cont = df.withColumn("t", F.col("t") + F.rand(3))
    c = cont.toPandas()
    pairs = (c["event"].to_numpy()[:, None] == 1) & (c["t"].to_numpy() > c["t"].to_numpy()[:, None])
    lower = c["score"].to_numpy() < c["score"].to_numpy()[:, None]
    assert E.c_index(spark_frame(df, c), "score", "t", "event").first()[0] == pytest.approx((pairs & lower).sum() / pairs.sum())


def spark_frame(df, pdf):
    return df.sparkSession.createDataFrame(pdf)


def test_kaplan_meier_reaches_zero_when_all_die(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "t long, e long")
    got = {r["t"]: (r["at_risk"], r["survival"]) for r in E.kaplan_meier(df, "t", "e").collect()}
    assert got[1] == (4, pytest.approx(0.75)) and got[3] == (2, 0.0) and 2 not in got


def test_keep_events_takes_an_exact_number(risk):
    d, df = risk
    e = int(d["event"].sum())
    for times, want in ((1, e), (0.5, int(e * 0.5)), (99, len(d) - e)):
        n = {r["event"]: r["count"] for r in H.keep_events(df, "event", ["id"], times).groupBy("event").count().collect()}
        assert n[1] == e and n.get(0, 0) == want
    a, b = (H.keep_events(x, "event", ["id"], 1).agg(F.sum("id")).first()[0] for x in (df, df.repartition(7)))
    assert a == b
    assert H.keep_events(df, "event", ["id"], None, cap=e + 10).count() == e + 10


def test_calibrated_intercept(risk):
    d, df = risk
    b = H.calibrate_intercept(df, "score", "event")
    assert (1 / (1 + np.exp(-(d["score"] + b)))).mean() == pytest.approx(d["event"].mean(), abs=1e-8)


def test_scores_add_up_and_refuse(spark):
    coefs = [{"kind": "intercept", "level": "Intercept", "coef": -2.0}, {"kind": "numeric", "level": "x", "coef": 0.5}, {"kind": "g", "level": "b", "coef": 1.0}]
    df = spark.createDataFrame([(1.0, "b", 2000), (3.0, "a", 2000), (1.0, "b", 1980), (1.0, "z", 2000), (1.0, "b", None)], "x double, g string, year long")
    rows = H.score_hazard(df, coefs, ["x"], ["g"], "year", (1990, 2010), {"g": ["z"]}, ["x"]).collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "year out of range", "degenerate level", "no year"]
    for r in rows[:2]:
        assert sum(c["value"] for c in r["contributions"]) == pytest.approx(r["eta"])
        assert r["hazard"] == pytest.approx(1 - math.exp(-math.exp(r["eta"])))
        assert r["eta_conservative"] == pytest.approx(r["eta"] - 0.5 * r["x"])
    assert rows[2]["hazard"] is None


def test_rolling_out_of_time_counts_unseen_levels(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"id": np.arange(1200), "year": np.repeat(np.arange(2000, 2004), 300), "x": rng.normal(size=1200)})
    d["event"] = (rng.random(1200) < 1 / (1 + np.exp(1 - d["x"]))).astype(int)
    d["g"] = np.where((d["year"] == 2003) & (d["id"] % 10 == 0), "new", np.where(d["id"] % 2 == 0, "a", "b"))
    rows, summary = H.rolling_out_of_time(spark.createDataFrame(d), "event", "year", ["id"], ["x"], ["g"], 50, 10)
    assert [r["year"] for r in rows] == [2001, 2002, 2003]
    assert rows[-1]["n_dropped_unseen_level"] == 30 and summary["auc_mean"] > 0.6
    assert H.holdout(spark.createDataFrame(d), "event", "year", 2001, ["id"], ["x"], ["g"])["n"] == 570


def test_grades(spark):
    runs = spark.createDataFrame(
        [(True, 1.0, 0.1), (True, 2.5, 0.1), (None, 1.0, 0.1), (False, 1.0, 0.1), (True, None, None), (True, 1.0, 0.6)],
        "exogenous boolean, pre_trend_t double, pre_trend_ratio double")
    assert [r["grade"] for r in E.evidence_grade(runs).collect()] == ["A", "B", "B", "C", "B", "C"]


def test_leak_scan_flags_names(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame([(e, y, rng.random(), e * 0.1, float(e), y - 1990 + e % 3) for e in range(60) for y in range(2000, 2008)],
                     columns=["uid", "year", "deposits", "bank_closed_rate", "area", "age"])
    rows = {r["field"]: r["name_hint"] for r in E.leak_scan(spark.createDataFrame(d), "uid", "year").collect()}
    assert rows == {"bank_closed_rate": True, "area": False}


def test_health_by_shape(spark):
    d = nan_to_null(spark.createDataFrame(pd.DataFrame({"k": np.arange(480) % 60, "y": 2000 + np.arange(480) // 60, "lat": np.where(np.arange(480) % 5 < 2, np.nan, 1.0), "lng": 1.0, "v": 1.0})))
    got = {r["key"]: r["level"] for r in E.health_checks(d, {"entity": "k", "time": "y", "lat": "lat", "lon": "lng", "value": "v"}, "panel").collect()}
    assert got["scale"] == "warn" and got["geo"] == "danger" and got["span"] == "ok" and got["panel"] == "ok"


def test_tails():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert tails.student_two_sided(1.96, 1e7) == pytest.approx(tails.normal_two_sided(1.96), abs=1e-6)
    assert tails.chi2_1_upper(3.841458820694124) == pytest.approx(0.05)
    assert tails.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
