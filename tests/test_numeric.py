import math

import numpy as np
import pytest

from sparkloom.functions import tails
from sparkloom.operators.normalize import drift_correct, lowess_matrix


def tail(spark, f, *columns):
    rows = [(*map(float, row),) for row in zip(*columns)]
    names = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return np.array([r[0] for r in df.select(f(*names)).collect()], float)


def test_tails_against_closed_forms(spark):
    x = np.array([0.1, 0.5, 1.0, 3.0, 10.0])
    near = lambda v: pytest.approx(v, rel=1e-10, abs=1e-12)
    assert tail(spark, tails.chi2_p, x, np.full(5, 2.0)) == near(np.exp(-x / 2))
    assert tail(spark, tails.chi2_p, x, np.full(5, 1.0)) == near([math.erfc(math.sqrt(v / 2)) for v in x])
    assert tail(spark, tails.chi2_p, 40 * x, np.full(5, 60.0)) == near([sum(math.exp(-20 * v + k * math.log(20 * v) - math.lgamma(k + 1)) for k in range(30)) for v in x])
    assert tail(spark, tails.t_p, x, np.full(5, 1.0)) == near([2 / np.pi * math.atan(1 / v) for v in x])
    assert tail(spark, tails.t_p, x, np.full(5, 2.0)) == near(1 - x / np.sqrt(2 + x * x))
    assert tail(spark, tails.t_p, -x, np.full(5, 7.0)) == near(tail(spark, tails.t_p, x, np.full(5, 7.0)))
    assert tail(spark, tails.f_p, x * x, np.full(5, 1.0), np.full(5, 9.0)) == near(tail(spark, tails.t_p, x, np.full(5, 9.0)))
    # With two degrees above, an F's tail is a power.
    assert tail(spark, tails.f_p, x, np.full(5, 2.0), np.full(5, 11.0)) == near((1 + 2 * x / 11) ** -5.5)
    assert tail(spark, tails.t_p, [2.228, 1.96], [10.0, 1e6]) == pytest.approx([0.05, 0.05], abs=2e-4)
    assert tail(spark, tails.normal_p, [0.0, 1.0, -1.959964, 6.0]) == near([math.erfc(v / math.sqrt(2)) for v in (0, 1, 1.959964, 6)])
    assert np.isnan(tail(spark, tails.t_p, [1.0, float("nan")], [0.0, 3.0])).all()


def test_tails_are_those_of_the_sql(spark):
    import duckdb

    rng = np.random.default_rng(0)
    t, d, e = rng.normal(0, 3, 200), rng.choice([1, 2.7, 8, 40.5, 900], 200), rng.choice([1.0, 2, 5, 60], 200)
    db = duckdb.connect()
    db.execute("CREATE TABLE v (t DOUBLE, d DOUBLE, e DOUBLE)")
    db.executemany("INSERT INTO v VALUES (?, ?, ?)", np.stack([t, d, e], 1).tolist())
    for f, sql, columns in ((tails.t_p, tails.sql_t_p, "td"), (tails.chi2_p, tails.sql_chi2_p, "dd"), (tails.normal_p, tails.sql_normal_p, "t"), (tails.f_p, tails.sql_f_p, "ded")):
        found = [x[0] for x in db.execute(f"SELECT {sql(*columns)} FROM v").fetchall()]
        assert tail(spark, f, *({"t": t, "d": d, "e": e}[c] for c in columns)) == pytest.approx(found, abs=1e-11)


def test_lowess_keeps_a_line():
    x = np.arange(12.0)
    assert lowess_matrix(x, 0.5) @ (3 + 2 * x) == pytest.approx(3 + 2 * x)
    # A value is the weighted line of its neighbours.
    y = np.sin(x)
    for i in (0, 5, 11):
        far = np.abs(x - x[i])
        w = np.clip(1 - (far / np.sort(far)[5]) ** 3, 0, None) ** 3
        line = np.polyfit(x, y, 1, w=np.sqrt(w))
        assert (lowess_matrix(x, 0.5) @ y)[i] == pytest.approx(np.polyval(line, x[i]))


def corrected(order, value, qc):
    """N8 for one feature, fit by fit."""
    usable = qc & np.isfinite(value) & (value > 0)
    if usable.sum() < 3:
        return value

    def trend(x, y, at):
        fit = lowess_matrix(x, 1.0 if len(x) <= 6 else 0.3) @ y if len(x) >= 5 else np.polyval(np.polyfit(x, y, 1), x)
        return np.interp(at, x, fit)

    x, y = order[usable], np.log10(value[usable])
    of = trend(x, y, order)
    of[usable] = [trend(np.delete(x, i), np.delete(y, i), x[i]) for i in range(len(x))]
    return value / 10**of * 10 ** np.median(of[usable])


def test_drift_is_removed(spark):
    rng = np.random.default_rng(1)
    order = np.arange(24.0)
    value = {f: 1000 * 10 ** (0.02 * order + rng.normal(0, 0.01, 24)) for f in range(12)}
    for f in range(12):
        value[f][rng.random(24) < f / 20] = np.nan
    qc = order % 2 == 0
    rows = [(f, int(s), float(order[s]), bool(qc[s]), None if np.isnan(v[s]) else float(v[s])) for f, v in value.items() for s in range(24)]
    schema = "feature_id int, sample_id int, inj_order double, is_qc boolean, value double"
    got = {(r["feature_id"], r["sample_id"]): r["value"] for r in drift_correct(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    for f, v in value.items():
        assert [np.nan if got[f, s] is None else got[f, s] for s in range(24)] == pytest.approx(corrected(order, v, qc), nan_ok=True)
    found = np.array([got[0, s] for s in range(24)])
    assert np.ptp(found[2:20]) / found.mean() < 0.2 < np.ptp(value[0][2:20]) / value[0].mean()
    few = spark.createDataFrame([(f, s, o, s < 2, v) for f, s, o, _, v in rows], schema)  # under three QC samples
    assert {(r["feature_id"], r["sample_id"]): r["value"] for r in drift_correct(few).collect()} == {(f, s): v for f, s, _, _, v in rows}
    assert drift_correct(few.limit(0)).count() == 0


def test_signed_ranks_by_enumeration(spark):
    expected = {}
    for n in (1, 3, 5, 8):
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(2**n)]
        expected |= {(n, w): min(1, 2 * sum(x <= w for x in sums) / 2**n) for w in range(n * (n + 1) // 2 + 1)}
    assert tail(spark, tails.signed_rank_p, *zip(*expected)) == pytest.approx(list(expected.values()))
    assert np.isnan(tail(spark, tails.signed_rank_p, [0.0, 51.0], [0.0, 3.0])).all()
