"""The time-series data operators against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import digest, hmm, readings, regrid
from tidewater.operators.asknown import as_known_join, usable_splits
from tidewater.operators.rolling import rolling_totals

NAN = float("nan")
INF = float("inf")
BARS = "src_order bigint, ts bigint, symbol string, close double, high double, low double, volume double"
TICKS = "src_order bigint, timestamp_ns bigint, symbol string, price double, size double, side string"


# ---- bad readings


def series(n=400, seed=1, level=100.0, sigma=0.001):
    return np.round(level * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sigma, n))), 2)


def judged(values, quantity=False):
    v = np.asarray(values, float)
    return hmm.bad_readings(v, ~((v > 0) & (v < INF)) if not quantity else v < 0, np.array([0]), np.array([quantity]))[0]


def test_median_of_seven():
    x = np.random.default_rng(0).random(500)
    assert np.allclose(hmm.rolling_median7(x), [np.median(x[i : i + 7]) for i in range(494)])


def test_spikes_stuck_runs_and_impossible_values_are_told_apart():
    x = series()
    x[50:52] *= 10
    x[120] *= 1.05
    x[200] = -3.0
    x[300:330] = x[300]
    state = judged(x)
    assert state[50] == state[51] == state[120] == hmm.SPIKE and state[200] == hmm.OUT
    assert (state[301:330] == hmm.STUCK).all() and state[300] == hmm.NORMAL
    assert (np.delete(state, [50, 51, 120, 200, *range(301, 330)]) == hmm.NORMAL).all()


def test_lasting_changes_and_quiet_symbols_are_normal():
    x = series()
    x[150:] = np.round(x[150:] * 1.3, 2)
    assert (judged(x) == hmm.NORMAL).all()
    quiet = np.round(np.repeat(series(60, sigma=0.003), np.random.default_rng(2).geometric(0.15, 60)), 2)
    assert (judged(quiet) != hmm.STUCK).all()


def test_zero_volume_is_legal_and_volume_spikes_are_upward():
    rng = np.random.default_rng(4)
    v = np.round(np.exp(rng.normal(8, 0.5, 400)))
    v[100:150] = 0
    v[200] = 1
    v[300] *= 5_000
    state = judged(v, quantity=True)
    assert np.flatnonzero(state).tolist() == [300]


def test_short_flat_and_empty_series():
    assert judged([5.0, 5.0]).tolist() == [0, 0] and judged([7.0]).tolist() == [0]
    assert (judged([3.0] * 12)[1:] == hmm.STUCK).all()  # frozen from its start
    assert len(judged([])) == 0


def test_cut_recursion_is_exact():
    rng = np.random.default_rng(9)
    e = rng.random((1000, 4)) + 0.01
    chain = rng.random((1, 3, 4, 4)) ** 3
    chain /= chain.sum(axis=-1, keepdims=True)
    kind = rng.integers(0, 3, 1000)
    got, begins = hmm._forward_backward(e, chain, kind, np.array([0]))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = np.array([1.0, 0, 0, 0])
    for t in range(1000):
        a = (a @ chain[0, kind[t]]) * e[t]
        a /= a.sum()
        alpha[t] = a
    for t in range(998, -1, -1):
        beta[t] = chain[0, kind[t + 1]] @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-10)
    for t in (1, 255, 256, 257, 999):
        both = alpha[t - 1][:, None] * chain[0, kind[t]] * (e[t] * beta[t])[None, :]
        assert np.isclose(begins[t], both[hmm.NORMAL, hmm.SPIKE] / both.sum())


def test_transitions_are_probabilities_and_verdicts_follow_the_posterior():
    for rate in (1e-6, hmm.SPIKE_RATE, 0.2):
        chain = hmm._chain(rate)
        assert (chain >= 0).all() and np.allclose(chain.sum(axis=-1), 1.0)
    x = series(3_000, seed=8)
    x[500:502] *= 3
    x[900:1_000] = x[900]
    x[1_500] = -1.0
    state, p, norms = hmm.bad_readings(x, x <= 0, np.array([0]), np.array([False]))
    assert ((state != hmm.NORMAL) == (p >= 0.5)).all()
    assert np.ptp(p[901:1_000]) < 1e-9 and (state[901:1_000] == hmm.STUCK).all()  # a run is frozen from its first repeat to its last
    assert norms[0, 0] == 3_000 and norms[0, 3] < hmm.SPIKE_RATE  # the spike rate came down to what the series shows


def market(spark):
    rng = np.random.default_rng(11)
    ticks, bars = [], []
    for k, (symbol, n) in enumerate([("HOT", 12_000), ("AAA", 300), ("BBB", 200), ("CCC", 900)]):
        x = series(n, seed=k, sigma=0.0005, level=200)
        hit = rng.choice(np.arange(20, n - 20), n // 100, replace=False)
        x[hit] *= 1.4
        for a in range(1_500, n - 1_000, 2_400):  # frozen for longer than the halo of the test below
            x[a : a + 700] = x[a]
        ticks += [(i, 1_700_000_000_000_000_000 + i * 1_000_000_000, symbol, float(p), 1.0, "TRADE") for i, p in enumerate(x)]
    ticks += [(90_000, 1_700_000_000_000_000_000, "HOT", ticks[0][3], 1.0, "TRADE"), (90_001, 5, None, 1.0, 1.0, None), (90_002, 1_700_000_000_500_000_000, "AAA", None, None, None)]
    for i, c in enumerate(series(120, seed=30)):
        bars.append((i, 1_600_000_000 + i * 3600, "AAA", float(c), float(c) + 1, float(c) - 1, 1000.0 + i))
    bars[40] = (40, *bars[40][1:3], bars[40][4] + 5, *bars[40][4:])  # above its own high
    bars.append((500, bars[40][1], "AAA", 100.0, None, None, 1000.0))  # supersedes it
    bars[50] = (50, *bars[50][1:3], bars[50][4] + 5, *bars[50][4:])
    bars.append((501, bars[60][1], "AAA", NAN, None, None, -5.0))
    return spark.createDataFrame(bars, BARS), spark.createDataFrame(ticks, TICKS)


def test_a_cut_series_is_judged_like_a_whole_one(spark, monkeypatch):
    bars, ticks = market(spark)
    monkeypatch.setattr(readings, "HALO", 200)
    whole = readings.flag_readings(readings.market_series(bars, ticks), (readings.VOLUME,), 1_000_000).toPandas()
    cut = readings.flag_readings(readings.market_series(bars, ticks), (readings.VOLUME,), 2_000).toPandas()
    key = ["field", "symbol", "ts", "state"]
    a, b = (set(map(tuple, d[key].to_numpy().tolist())) for d in (whole, cut))
    assert len(a) > 100 and len(a) == len(whole) and len(b) == len(cut)
    assert a == b and len(whole[whole.state == hmm.STUCK]) >= 2_700
    assert (whole.p_bad >= 0.5).all() and (cut.p_bad >= 0.5).all()
    found = set(map(tuple, whole[["field", "ts"]].to_numpy().tolist()))
    assert (readings.CLOSE, 1_600_000_000 + 50 * 3600) in found and (readings.CLOSE, 1_600_000_000 + 40 * 3600) not in found
    assert (readings.VOLUME, 1_600_000_000 + 60 * 3600) in found


def test_readings_of_empty_tables(spark):
    assert readings.bad_market_readings(spark.createDataFrame([], BARS), spark.createDataFrame([], TICKS)).count() == 0


# ---- percentiles


@pytest.mark.parametrize("shape", ["lognormal", "ties", "two", "uniform"])
def test_digest_rank_errors_are_bounded_and_merging_keeps_them(shape):
    rng = np.random.default_rng(5)
    x = {"lognormal": rng.lognormal(0, 3, 40_000), "ties": np.round(rng.random(40_000), 1), "two": rng.choice([1.0, 2.0], 40_000, p=[0.6, 0.4]), "uniform": rng.random(40_000)}[shape]
    parts = [digest.digest_of(p) for p in np.array_split(x, 37)]
    merged = digest.merge([digest.merge(parts[:20]), digest.merge(parts[20:])])
    assert merged[1].sum() == len(x) and len(merged[0]) < 1_000
    s = np.sort(x)
    for q in (0.01, 0.5, 0.95, 0.99, 0.999):
        v = digest.quantile(merged, q)
        lo, hi = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right")
        assert max(0, lo - q * len(x), q * len(x) - hi) / len(x) < 0.005, (shape, q)


LATENCY = "run_id string, sample_no bigint, run_date date, stage string, elapsed_seconds double, grp string, value double, n int"


def test_stored_digests_of_days_combine(spark):
    rng = np.random.default_rng(12)
    rows = [(f"r{i % 7}", i, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i % 14), ["hot", None][i % 3 == 0], float(rng.lognormal(0, 2)), "x", 1.0, 1) for i in range(9_000)]
    rows += [rows[5], (None, 3, rows[0][2], "hot", 1.0, "x", 1.0, 1), (None, 3, rows[0][2], "hot", 1.0, "x", 1.0, 1), ("r0", 0, rows[1][2], "hot", 1e9, "x", 1.0, 1)]
    df = spark.createDataFrame(rows, LATENCY)
    stored = digest.day_digests(df, delta=60)
    assert stored.count() == 28 and stored.where("size(mean) > 90").count() == 0
    first, second = stored.where("day < '2024-01-08'"), stored.where("day >= '2024-01-08'")  # written apart, read together
    got = digest.combined_percentiles(first.unionByName(second), F.date_trunc("month", F.col("day"))).toPandas()
    kept = pd.DataFrame(rows[:9_000] + rows[9_001:9_003], columns=["run", "no", "day", "stage", "v", *"abc"])  # the copies of a sample count once, unnamed samples each
    for _, r in got.iterrows():
        of = kept[kept.stage.isna() if r["grp"] is None else kept.stage == r["grp"]].v.sort_values().to_numpy()
        assert r.n == len(of)
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            error = max(0, np.searchsorted(of, r[name], "left") - q * len(of), q * len(of) - np.searchsorted(of, r[name], "right")) / len(of)
            assert error <= r[f"rank_bound_{name}"] + 1e-12 and r[f"rank_bound_{name}"] < 0.15


def test_certified_percentiles_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(6_000):
        stage = ["hot", "hot", "warm", None][i % 4]
        v = [float(rng.lognormal()), 0.0, NAN, INF, -1.0, None][0 if i % 50 else i // 50 % 6]
        rows.append((f"r{i % 70}", i, pd.Timestamp("2025-01-01").date() + pd.Timedelta(days=i % 3), stage, v, "x", 1.0, 1))
    rows += rows[:500]
    out = digest.certified_percentiles(spark.createDataFrame(rows, LATENCY).repartition(5)).toPandas()
    d = pd.DataFrame(rows, columns=[c.split()[0] for c in LATENCY.split(", ")]).drop_duplicates(["run_id", "sample_no"])
    d = d[d.elapsed_seconds.notna() & np.isfinite(d.elapsed_seconds.astype(float)) & (d.elapsed_seconds >= 0)]
    assert out["certified"].all() and len(out) == 3 + 9
    for r in out[out.level == "group"].itertuples():
        mine = d[d.stage.isna() if r.stage is None or r.stage != r.stage else d.stage == r.stage].elapsed_seconds.sort_values().to_numpy()
        assert r.n == len(mine)
        for q, v, e in ((0.5, r.p50, r.rank_error_p50), (0.95, r.p95, r.rank_error_p95), (0.99, r.p99, r.rank_error_p99)):
            lo, hi = np.searchsorted(mine, v, "left"), np.searchsorted(mine, v, "right")
            assert np.isclose(e, max(0, lo - q * len(mine), q * len(mine) - hi) / len(mine)) and e < 0.01
    assert digest.certified_percentiles(spark.createDataFrame([], LATENCY)).count() == 0


# ---- regular grid


def test_grid_marks_missing_minutes_and_fills_them(spark):
    base = 1_700_000_000 // 86_400 * 86_400 * 10**9
    minute = regrid.MINUTE_NS
    rows = [(i, base + i * minute + 5 * 10**9, "AAA", 100.0 + 0.1 * i, 2.0, "bid") for i in range(60) if not 20 <= i < 30]
    rows += [(100, *rows[3][1:]), (101, base + 70 * minute, "AAA", None, 1.0, None), (102, base + 71 * minute, "AAA", NAN, 1.0, None)]
    rows += [(103, base + 75 * minute, "AAA", -1.0, None, None), (104, base + 1_440 * minute, "AAA", 50.0, 1.0, None), (105, base, None, 9.0, 1.0, None), (106, base, "NEG", -5.0, 1.0, None)]
    out = regrid.minute_grid(spark.createDataFrame(rows, TICKS)).toPandas()
    a = out[(out.symbol == "AAA") & (out.minute_start < base // 10**9 + 86_400)].sort_values("minute_start").reset_index(drop=True)
    assert len(a) == 76 and a["missing"].sum() == 10 + 15 and a["missing"][20:30].all() and not a["missing"][75]
    assert a["n_readings"][3] == 1 and a["total_size"][3] == 2.0 and a["last_price"][75] == -1.0
    assert np.abs(a["fill_price"][20:30] - (100.0 + 0.1 * (np.arange(20, 30) + 0.9))).max() < 0.2
    assert a["fill_sd"][25] > a["fill_sd"][10] > 0
    assert len(out[out.symbol == "NEG"]) == 1 and out[out.symbol == "NEG"]["fill_price"].isna().all()
    assert len(out) == 76 + 1 + 1
    assert regrid.minute_grid(spark.createDataFrame([], TICKS)).count() == 0


def test_smoother_equals_the_joint_gaussian():
    """The smoothed grid values are the conditional means of the model, computed by linear algebra."""
    rng = np.random.default_rng(8)
    steps, lq, sq, r = 12, 0.3, 0.05, 0.2
    at = rng.random(steps) * 0.9 + 0.05
    seen = np.array([1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1], bool)
    y = np.where(seen, rng.normal(0, 1, steps), 0.0)
    got, var = regrid.smooth_on_grid(y[None], at[None], seen[None], *(np.array([v]) for v in (lq, sq, r)))
    times = np.concatenate([np.arange(steps) + np.where(seen, at, 0.5), np.arange(1, steps + 1)])
    order = np.argsort(times)
    p = np.diag([r + lq, sq + 1e-12])
    mean0 = np.array([y[0], 0.0])
    n = len(times)
    big, now, last = np.zeros((2 * n, 2 * n)), p, 0.0
    fs, ps = [], []
    for t in times[order]:
        dt = t - last
        f = np.array([[1, dt], [0, 1]])
        q = np.array([[lq * dt + sq * dt**3 / 3, sq * dt**2 / 2], [sq * dt**2 / 2, sq * dt]])
        now = f @ now @ f.T + q
        fs.append(f)
        ps.append(now)
        last = t
    for i in range(n):
        big[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = ps[i]
        carry = ps[i]
        for j in range(i + 1, n):
            carry = fs[j] @ carry
            big[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = carry
            big[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = carry.T
    level = big[::2, ::2]
    place = {int(k): i for i, k in enumerate(order)}
    obs = [place[k] for k in range(steps) if seen[k]]
    grid = [place[steps + k] for k in range(steps)]
    gain = level[np.ix_(grid, obs)] @ np.linalg.inv(level[np.ix_(obs, obs)] + r * np.eye(len(obs)))
    want = mean0[0] + gain @ (y[seen] - mean0[0])
    assert np.allclose(got[0], want, atol=1e-8)
    assert np.allclose(var[0], np.diag(level[np.ix_(grid, grid)] - gain @ level[np.ix_(obs, grid)]), atol=1e-8)


# ---- as known


ACTIONS = "action_id bigint, symbol string, ex_date_timestamp bigint, action_type string, ratio_or_amount double, known_at bigint, ts bigint, period int"


def test_as_known_join_matches_brute_force(spark):
    rng = np.random.default_rng(12)
    events = [(s, int(t)) for s in ("A", "B", "C") for t in rng.integers(0, 5_000_000, 300)] + [("A", 7), ("A", 7), (None, 5), ("A", None)]
    actions = []
    for i in range(60):
        ex = int(rng.integers(0, 5_000_000))
        actions.append((i, ["A", "B", "Z", None][i % 4], None if i % 13 == 0 else ex, [" split ", "SPLIT", "DIVIDEND"][i % 3], [2.0, 0.0, -1.0, None, NAN, 0.5, 3.0][i % 7], ex + int(rng.integers(-10**6, 10**6)), 1, 2))
    actions += [(900 + a[0], *a[1:]) for a in actions[:20]]
    e = spark.createDataFrame([(s, t, "x") for s, t in events], "symbol string, ts bigint, state string")
    good = usable_splits(spark.createDataFrame(actions, ACTIONS))
    for period in (1_000, 86_400 * 7, 10**9):
        got = {(r["symbol"], r["ts"]): (r["action_id"], r["ratio_or_amount"]) for r in as_known_join(e, good, period=period).collect()}
        assert set(got) == set(events)
        for (s, t), found in got.items():
            fit = [a for a in actions if s and t is not None and a[1] == s and a[2] is not None and a[3].strip().upper() == "SPLIT" and a[4] and a[4] > 0 and a[2] <= t and a[5] <= t]
            best = max(fit, key=lambda a: (a[2], a[5], a[0]), default=None)
            assert found == ((best[0], best[4]) if best else (None, None))
    matched = as_known_join(e, good, keep_unmatched=False)
    assert matched.count() == sum(v[0] is not None for v in got.values())
    assert as_known_join(e.limit(0), good).count() == 0 and as_known_join(e, good.limit(0), keep_unmatched=False).count() == 0


# ---- rolling totals


def test_rolling_totals_match_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(600):
        day = int(rng.choice([*range(0, 40), *range(90, 120)]))
        close = [float(rng.integers(1, 100)), None, NAN][0 if i % 9 else i % 3]
        rows.append((i, day * 86_400 + int(rng.integers(0, 86_400)), ["A", "B", None][i % 3], close, 0.0, 0.0, 0.0))
    rows += [(1_000 + r[0], *r[1:3], 5.0, *r[4:]) for r in rows[:30]]
    out = rolling_totals(spark.createDataFrame(rows, BARS).withColumn("bucket", F.lit(1)).withColumn("date", F.lit(2))).toPandas()
    d = pd.DataFrame(rows, columns=["o", "ts", "s", "c", "h", "l", "v"]).dropna(subset=["s"]).sort_values("o").drop_duplicates(["s", "ts"], keep="last").dropna(subset=["c"])
    d["day"] = d.ts // 86_400
    for s in ("A", "B"):
        mine, g = d[d.s == s], out[out.symbol == s].set_index("epoch_day").sort_index()
        assert g.index.tolist() == list(range(mine.day.min(), mine.day.max() + 1))
        for day, r in g.iterrows():
            assert r["is_active"] == (mine.day == day).any()
            for n in (7, 30):
                part = mine[(mine.day <= day) & (mine.day > day - n)].c
                assert r[f"count_{n}d"] == len(part) and r[f"total_{n}d"] == part.sum()
                assert np.isclose(r[f"avg_{n}d"], part.mean(), equal_nan=True)
    assert rolling_totals(spark.createDataFrame([], BARS)).count() == 0


def test_every_reading_of_a_minute_counts_at_its_own_time():
    rng = np.random.default_rng(5)
    counts = np.array([3, 1, 7, 2])
    slot = np.array([0, 1, 4, 5])
    minutes, (lq, sq, r) = np.repeat(slot, counts), (0.03, 0.002, 0.01)
    at = np.concatenate([np.sort(rng.uniform(0.01, 1.0, n)) for n in counts])
    x = rng.normal(0, 0.3, len(at))
    own = [np.full(len(counts), v) for v in (lq, sq, r)]
    got, var = regrid.smooth_summaries(regrid.minute_summaries(x, at, counts, *own), np.zeros(4, int), slot, 7, np.array([0.0]), *(np.array([v]) for v in (lq, sq, r)))
    times = np.append(minutes + at, np.arange(1.0, 8.0))
    low = np.minimum.outer(times, times)
    high = np.maximum.outer(times, times)
    cov = (r + lq) + lq * low + np.outer(times, times) * (sq + 1e-12) + sq * low**2 * (3 * high - low) / 6
    n = len(x)
    gain = cov[n:, :n] @ np.linalg.inv(cov[:n, :n] + r * np.eye(n))
    assert np.allclose(got[0], gain @ x, atol=1e-8)
    assert np.allclose(var[0], np.diag(cov[n:, n:] - gain @ cov[:n, n:]), atol=1e-8)


def test_earlier_readings_of_a_minute_steer_the_fill(spark):
    base = 1_700_000_000 // 86_400 * 86_400 * 10**9
    rng = np.random.default_rng(8)
    level = 100 + np.cumsum(rng.normal(0, 0.2 / np.sqrt(30), 3_600))
    rows = [(i, base + (i + 1) * regrid.MINUTE_NS // 30 - 1, "AAA", float(level[i] + rng.normal(0, 0.2)), 1.0, "bid") for i in range(3_600)]
    full, thin = (regrid.minute_grid(spark.createDataFrame(x, TICKS)).toPandas().sort_values("minute_start") for x in (rows, rows[29::30]))
    assert full["n_readings"].eq(30).all() and thin["n_readings"].eq(1).all()
    error = lambda out: float(np.sqrt(np.mean((out["fill_price"].to_numpy() - level[29::30]) ** 2)))
    assert error(full) < 0.8 * error(thin) and full["fill_sd"].median() < thin["fill_sd"].median()
