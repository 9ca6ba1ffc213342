"""Hand-sized cases: ties, warm-up, gaps, state machines, look-ahead, partitioning."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.functions import discretize as P, features as X
from barweave.functions.windows import chunked
from barweave.functions import slices as L
from barweave.operators import mining as M, positions as H, resample as R, streaks as Q, tests_of_chance as T
from barweave.operators.boosting import boosted
from barweave.operators.chains import Holding, Trading
from barweave.plans import workloads as W
from barweave.sources import io as S
from barweave.streaming import stream as ST

T0 = datetime(2024, 1, 1)


def series(spark, closes, asset="a", step=3600):
    data = [(asset, "1h", T0 + timedelta(seconds=step * i), *[float(c)] * 4, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, S.BAR)


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("ts").collect()]


def test_streaks_with_flat_and_missing(spark):
    bars = X.pct_return(series(spark, [1.0, 2, 3, 3, 2, 1, 2]), 1, name="return_1h")
    out = X.streak_before(X.streak_signed(bars))
    assert values(out, "streak_signed") == [0, 1, 2, 0, -1, -2, 1]
    assert values(out, "streak") == [0, 0, 1, 2, 0, -1, -2]


def test_session_streak_starts_anew_but_reads_the_last_return(spark):
    bars = X.pct_return(series(spark, [1.0, 2, 3, 4, 5], step=43200), 1, name="return_1h")
    assert values(X.streak_session(bars), "streak") == [0, 0, 1, 2, 1]


def test_rolling_waits_for_full_windows(spark):
    out = X.rolling_vol(X.pct_return(series(spark, [1.0, 2, 1, 2, 1]), 1, name="return_1h"), 3)
    assert [v is None for v in values(out, "volatility")] == [True, True, True, False, False]


def test_zero_denominators_are_null(spark):
    out = X.range_features(series(spark, [1.0]))
    assert values(out, "close_pos") == [None] and values(out, "range_pct") == [0.0]


def test_state_ties_are_low_first(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (1.5, 1.0, 2.0), (None, 1.0, 2.0)], "x double, lo double, hi double")
    assert [r[0] for r in df.select(P.state(F.col("x"), F.col("lo"), F.col("hi"))).collect()] == ["LOW", "HIGH", "MID", None]


def test_tied_votes(spark):
    events = spark.createDataFrame([("a", "1h", T0, "e1"), ("a", "1h", T0, "e2")], "asset string, res string, ts timestamp, event string")
    rules = spark.createDataFrame([("a", "1h", "e1", 0.6, 1), ("a", "1h", "e2", 0.6, 0)], "asset string, res string, event string, confidence double, direction int")
    assert M.predict_votes(events, rules).first()["pred"] == 0
    assert M.predict_calibrated(events, rules).first()["pred"] == 1


def test_asof_join_edges(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in (0, 1, 5)], "asset string, ts timestamp")
    right = spark.createDataFrame([("a", T0 + timedelta(hours=1), 7), ("b", T0, 9)], "asset string, ts timestamp, v int")
    assert values(R.asof_join(left, right), "v") == [None, 7, 7]
    assert values(R.asof_join(left, right, tolerance="4h"), "v") == [None, 7, 7]
    assert values(R.asof_join(left, right, tolerance="3h"), "v") == [None, 7, None]


def test_tidy_ohlcv_keeps_last_and_drops_bad(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "1", 0), ("2024-01-01 00:00:00", "2", 1), ("soon", "3", 2), ("2024-01-01 01:00:00", None, 3)], "Date string, CLOSE string, _seq int")
    raw = raw.withColumns({"asset": F.lit("a"), "res": F.lit("1h"), "open": F.lit("1"), "HIGH ": F.lit("2"), "low": F.lit("1"), "volume": F.lit("5")})
    assert [r["close"] for r in S.tidy_ohlcv(raw).collect()] == [2.0]
    with pytest.raises(ValueError, match="lack"):
        S.tidy_ohlcv(raw.drop("volume"))


def naive_hold(target, n):
    pos, cur, held = [], 0.0, 0
    for want in target:
        if want == cur:
            held += cur != 0
        elif held >= n or cur == 0:
            cur, held = want, int(want != 0)
        else:
            held += 1
        pos.append(cur)
    return pos


def in_pieces(machine, values, cuts):
    """What the machine says of a series cut into pieces, each worked by itself but for its start state."""
    size = len(next(iter(values.values())))
    state, parts = list(machine.start), []
    for a, b in zip([0, *cuts], [*cuts, size]):
        near = slice(max(0, a - machine.before), min(size, b + machine.after))
        have, first = {k: v[near] for k, v in values.items()}, a - near.start
        if b > a:
            at, made = machine.walk(have, first, b - a, state)
            parts.append((at + near.start, made))
            state = list(machine.step(state, np.array(machine.table(have, first, b - a), dtype=float), b - a))
    at = np.concatenate([x for x, _ in parts])
    assert list(at) == list(range(size))  # each bar once
    return [list(np.concatenate([np.asarray(made[i], dtype=object) for _, made in parts])) for i in range(len(parts[0][1]))]


def cuts_of(rng, size):
    return sorted(rng.randrange(size + 1) for _ in range(rng.choice([0, 1, 3, size])))


@pytest.mark.parametrize("n", [1, 2, 5, 70])
def test_min_hold_in_pieces_like_a_plain_loop(n):
    rng = random.Random(n)
    for _ in range(200):
        target = [float(rng.choice([-1, 0, 1, 1, 0.5])) for _ in range(rng.randrange(1, 60))]
        values = {"target": np.array(target), "n": np.full(len(target), float(n))}
        assert in_pieces(Holding(), values, cuts_of(rng, len(target)))[0] == naive_hold(target, n)


def test_one_series_in_64_pieces():
    rng = np.random.default_rng(6)
    target = np.repeat(rng.choice([-1.0, 0.0, 1.0], 4000), rng.integers(1, 9, 4000))
    ret = rng.normal(0, 0.002, len(target))
    cuts = [len(target) * k // 64 for k in range(1, 64)]
    assert in_pieces(Holding(), {"target": target, "n": np.full(len(target), 12.0)}, cuts)[0] == naive_hold(list(target), 12)
    for on_flip in (True, False):
        pos = in_pieces(Trading(0.003, 0.0045, 48, 6, 3, on_flip), {"signal": target, "ret": ret}, cuts)
        assert pos == told(H.thesis_trades(target, ret, 0.003, 0.0045, 48, 6, 3, on_flip), len(target))


def told(trades, size):
    pos, reason = [0.0] * size, [None] * size
    for first, last, side, why in trades:
        pos[first : last + 1], reason[last] = [side] * (last + 1 - first), why
    return [pos, reason]


def test_trades_in_pieces():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 40)
        signal, ret = np.array([float(rng.choice([-1, 0, 1, 1])) for _ in range(n)]), np.array([rng.choice([-2, -1, 0, 1, 2]) / 64 for _ in range(n)])
        rest = rng.choice([3, 5]) / 64, rng.choice([3, 5]) / 64, rng.randrange(1, 9), rng.randrange(0, 5), rng.randrange(0, 3), rng.random() < 0.5
        assert in_pieces(Trading(*rest), {"signal": signal, "ret": ret}, cuts_of(rng, n)) == told(H.thesis_trades(signal, ret, *rest), n)


def bar_by_bar(signal, ret, tp, sl, most, least, cooldown, on_flip):
    """Trades of the stated rules, looked up bar by bar."""
    out, i = [], 0
    while i < len(signal):
        if not signal[i] or on_flip and i and signal[i] == signal[i - 1]:
            i += 1
            continue
        for j in range(i + 1, len(signal)):
            gain, bars = sum(signal[i] * r for r in ret[i : j + 1]), j - i + 1
            why = [k for k, x in (("tp", gain >= tp and bars >= least), ("sl", gain <= -sl and bars >= least), ("timeout", bars >= most), ("invalidate", bars >= least and signal[j] == -signal[i])) if x]
            if why:
                out.append((i, j, signal[i], why[0]))
                break
        else:
            return [*out, (i, len(signal) - 1, signal[i], None)]
        i = j + 1 + cooldown
    return out


def test_thesis_trades():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 40)
        signal, ret = [float(rng.choice([-1, 0, 1, 1])) for _ in range(n)], [rng.choice([-2, -1, 0, 1, 2]) / 64 for _ in range(n)]
        rest = rng.choice([3, 5]) / 64, rng.choice([3, 5]) / 64, rng.randrange(1, 9), rng.randrange(0, 5), rng.randrange(0, 3), rng.random() < 0.5
        assert H.thesis_trades(np.array(signal), np.array(ret), *rest) == bar_by_bar(signal, ret, *rest)


def test_repeated_stamps_stay_as_many(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 1, -1.0, "y"), ("a", 2, None, None)], "asset string, ts long, target double, note string").coalesce(1)
    out = H.min_hold(rows, 2, ["asset"]).collect()
    assert len(out) == 3 and {r["note"] for r in out} == {"x", "y", None}


def long_rows(spark, n, seed):
    """Two series, one of them long, one under a null key, with repeated and null times."""
    rng = random.Random(seed)
    data = [("a" if rng.random() < 0.8 else None, T0 + timedelta(minutes=rng.randrange(n)) if rng.random() > 0.01 else None, rng.choice([-1.0, 0.0, 1.0, 1.0, None]), i, "x") for i in range(n)]
    return spark.createDataFrame(data, "asset string, ts timestamp, target double, id long, _n string").repartition(3)


def test_numbers_over_slices(spark):
    df = long_rows(spark, 400, 1).drop("_n")
    got = {r["id"]: (r["_at"], r["_n"]) for r in L.numbered(df, 30, ["asset"], ["id"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["asset"] is not None, r["ts"] is not None, r["ts"] or T0, r["id"]))
    for asset in ("a", None):
        own = [r["id"] for r in rows if r["asset"] == asset]
        assert [got[i] for i in own] == [(k, len(own)) for k in range(len(own))]
    assert L.numbered(df, 30, ["asset"]).select("_key", "_slice").distinct().count() > 10
    assert L.numbered(df.where("false"), 30, ["asset"]).count() == 0


def test_chunks_of_null_keys_and_repeated_times(spark):
    df = long_rows(spark, 400, 2)
    got = H.min_hold(df, 4, ["asset"], rows=25).collect()
    assert sorted(r["id"] for r in got) == list(range(400))
    for asset in ("a", None):
        own = sorted((r for r in got if r["asset"] == asset), key=lambda r: (r["ts"] is not None, r["ts"] or T0, r["target"] or 0.0))
        want = naive_hold([r["target"] or 0.0 for r in own], 4)
        # rows of one time and target can't be told apart: they have the same positions in some order
        groups = {}
        for r, pos in zip(own, want):
            groups.setdefault((r["ts"], r["target"] or 0.0), []).append((r["pos"], pos))
        assert all(sorted(a for a, _ in g) == sorted(b for _, b in g) for g in groups.values())
    assert H.min_hold(df.where("false"), 4, ["asset"], rows=25).count() == 0


@pytest.mark.parametrize("rows", [3, 50, 10_000])
def test_slices_like_whole_series(spark, rows):
    rng = random.Random(rows)
    data = [(a, T0 + timedelta(minutes=i + (500 if i > 200 else 0)), rng.choice([-1.0, 1.0, 1.0, 0.0, None]) if i < 100 or i > 180 else 1.0) for a in ("a", "b") for i in range(rng.randrange(250, 300))]
    df = spark.createDataFrame(data, "asset string, ts timestamp, return_1h double").repartition(3)
    whole = X.streak_before(X.streak_signed(df, by=["asset"]), by=["asset"])
    cut = X.streak_before(X.streak_signed(df, by=["asset"], rows=rows), by=["asset"], rows=rows)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.select(whole.columns).collect()))
    right = df.where(F.minute("ts") % 7 == 0).select("asset", F.col("ts").alias("at"), F.col("return_1h").alias("v"))
    for tolerance in (None, "1h"):
        a, b = (R.asof_join(df, right, tolerance=tolerance, right_on="at", rows=x) for x in (None, rows))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    a, b = (P.three_way(P.chrono_split(df, by=["asset"], rows=x, name="two"), by=["asset"], rows=x) for x in (None, rows))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_by_selection(spark, accuracy):
    rng = random.Random(accuracy)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.random(), 0.5, 0.25, None]), float(rng.randrange(3)), "x") for _ in range(6000)] + [("one", 2.0, None, "x"), ("two", -1.0, 1.0, "x"), ("two", 4.0, 2.0, "x")]
    df = spark.createDataFrame(data, "asset string, u double, v double, i string").repartition(4)
    q = [0.0, 1 / 3, 0.5, 0.99, 1.0]
    want = df.groupBy("asset").agg(F.percentile("u", q).alias("u"), F.percentile("v", q).alias("v"))
    got = P.exact_quantiles(df, ["u", "v"], q, ["asset"], accuracy)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert P.exact_quantiles(df.where("false"), ["u"], q, ["asset"]).count() == 0


def test_shuffled_labels_have_the_exact_mean_and_deviation(spark):
    rng = random.Random(7)
    data = [(rng.choice("ab"), s, int(rng.random() < 0.2 + 0.3 * s), round(rng.gauss(s, 1), 1), "x") for s in (rng.randrange(2) for _ in range(3000))]
    df = spark.createDataFrame(data, "asset string, s int, l int, v double, c string").repartition(3)
    for block in (10, 20_000):
        for r in T.permute_means(df, "l", "v", ["s"], n=400, by=["asset"], block=block).collect():
            own = [x for x in data if x[0] == r["asset"]]
            k, n = sum(x[2] for x in own), len(own)
            mean = var = 0.0
            for s in (0, 1):
                v, ones = np.array([x[3] for x in own if x[1] == s]), sum(x[2] for x in own if x[1] == s)
                mean += ones * v.mean()
                var += ones * v.var(ddof=1) * (1 - ones / len(v))
            total = sum(x[3] for x in own)
            exact, spread = mean / k - (total - mean) / (n - k), var**0.5 * (1 / k + 1 / (n - k))
            assert abs(r["null_mean"] - exact) < 4 * spread / 400**0.5 and 0.85 < r["null_std"] / spread < 1.15
            assert r["observed"] == pytest.approx(np.mean([x[3] for x in own if x[2]]) - np.mean([x[3] for x in own if not x[2]]))
    none = T.permute_means(df.where("l = 1"), "l", "v", ["s"], n=5, by=["asset"]).collect()
    assert len(none) == 2 and all(r["observed"] is None and r["p_value"] is None for r in none)
    assert T.permute_means(df.where("false"), "l", "v", n=5).count() == 0


def test_pair_in_chunks(spark):
    rng = random.Random(8)
    pair = spark.createDataFrame([(T0 + timedelta(hours=i), rng.choice([rng.gauss(0, 1), 0.0, None]), rng.gauss(0, 1)) for i in range(300)], "ts timestamp, a_ret double, b_ret double").repartition(3)
    for whole, cut in zip(Q.cross_asset_corr(pair, window=40), Q.cross_asset_corr(pair, window=40, rows=17)):
        flat = lambda df: sorted((tuple(round(x, 9) for x in r) for r in df.collect()))
        assert flat(whole) == flat(cut)


def walk_rows(spark):
    rng = random.Random(9)
    data = []
    for i in range(400):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append(("a", "1h", T0 + timedelta(hours=i), x, y, 0.0, (x if i < 250 else -x) + rng.gauss(0, 0.3)))
    return spark.createDataFrame(data, "asset string, res string, ts timestamp, x double, y double, return_6h double, fwd double")


def test_memory_goes_into_the_walk(spark):
    """x turns its sign at bar 250: its rules fail in the folds after it, once each, and are blocked after that."""
    cfg = W.Config(atoms=("x", "y"), sizes=(2,), min_support=5, min_conf=0.5)
    rows = walk_rows(spark)
    plain = W.walk_forward(rows, cfg)
    rules, hits = plain["rules"].toPandas(), plain["hits"].toPandas()
    bad = {(r.fold, r.event) for r in hits.itertuples() if r.oos_hit <= 0.5}
    want = {(r.fold, r.event) for r in rules.itertuples() if sum((f, r.event) in bad for f in range(r.fold)) < 2}
    assert want != {(r.fold, r.event) for r in rules.itertuples()}
    taught = W.walk_forward(rows, cfg, max_failures=2)
    assert {(r["fold"], r["event"]) for r in taught["rules"].collect()} == want
    gone = rules["event"].iloc[0]
    blocked = spark.createDataFrame([("a", "1h", gone)], "asset string, res string, event string")
    assert {r["event"] for r in W.walk_forward(rows, cfg, blocked)["rules"].collect()} == set(rules["event"]) - {gone}
    positive = spark.createDataFrame([("a", "1h", e, 0.9) for e in set(rules["event"])], "asset string, res string, event string, avg_oos_hit double")
    regimes = rows.select("asset", "res", "ts", F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("regime"))
    out = W.walk_forward(rows, cfg, positive=positive, regimes=regimes)
    assert {round(r["raw_prob"], 9) for r in out["calibrated"].collect()} == {0.9}
    by_regime = {r["regime"]: r["n"] for r in out["by_regime"].collect()}
    assert set(by_regime) == {"am", "pm", "ALL"} and by_regime["ALL"] == by_regime["am"] + by_regime["pm"]


def test_sweep_tests_the_winner_only(spark):
    cfg = W.Config(atoms=("x", "y"), sizes=(2,), min_support=5, min_conf=0.5)
    out = W.sweep({"all": (walk_rows(spark), cfg), "strict": (walk_rows(spark), W.replace(cfg, min_conf=0.9))}, n_draws=50).collect()
    assert [(r["rank"], r["test_p"] is not None, r["test_n"] is not None) for r in sorted(out, key=lambda r: r["rank"])] == [(1, True, True), (2, False, False)]
    assert all(0 < r["test_p"] <= 1 for r in out if r["rank"] == 1)


def plain_boosting(x, y, train, trees, depth, rate, bins, least, ridge):
    edges = [np.unique(np.quantile(c[train], [i / bins for i in range(1, bins)])) for c in x.T]
    b = np.array([[int((e <= v).sum()) for v, e in zip(row, edges)] for row in x])
    m = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), dtype=int)
        for _ in range(depth):
            new = 2 * node
            for k in np.unique(node[train]):
                own = train & (node == k)
                best = None
                for f in range(x.shape[1]):
                    for cut in np.unique(b[own, f]):
                        left = own & (b[:, f] <= cut)
                        right = own & ~left
                        if left.sum() < least or right.sum() < least:
                            continue
                        gain = round(sum(s * g[z].sum() ** 2 / (h[z].sum() + ridge) for s, z in ((1, left), (1, right), (-1, own))), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, f, cut
                if best:
                    new[(node == k) & (b[:, best[1]] > best[2])] += 1
            node = new
        for k in np.unique(node[train]):
            own = train & (node == k)
            m[node == k] += -rate * g[own].sum() / (h[own].sum() + ridge)
    return m


def test_boosting_of_all_series_like_numpy(spark):
    rng = np.random.default_rng(10)
    data = []
    for asset, n in (("a", 300), ("b", 120), (None, 90)):
        x = rng.normal(size=(n, 2)).round(3)
        y = (x[:, 0] * (1 if asset == "a" else -1) + x[:, 1] ** 2 + rng.normal(size=n) > 0.5).astype(int)
        data += [(asset, i, *map(float, r), int(v), "c") for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*data, ("a", 999, None, 1.0, 1, "c"), ("a", 998, 1.0, 1.0, None, "c")], "asset string, i long, u double, v double, up int, b string").repartition(3)
    got = {(r["asset"], r["i"]): r["margin"] for r in boosted(df, ["u", "v"], "up", F.col("i") % 4 != 0, ["asset"], trees=3, depth=2, bins=8, least=10).collect()}
    for asset in ("a", "b", None):
        own = [r for r in data if r[0] == asset]
        x, y, i = np.array([r[2:4] for r in own]), np.array([r[4] for r in own]), np.array([r[1] for r in own])
        want = plain_boosting(x, y, i % 4 != 0, 3, 2, 0.1, 8, 10, 1.0)
        assert [got[asset, k] for k in i] == pytest.approx(list(want), abs=1e-9)
    assert len(got) == len(data)


def test_drawdown_peak_leaves_out_the_start(spark):
    df = spark.createDataFrame([("a", "1h", T0 + timedelta(hours=i), r) for i, r in enumerate([-0.5, 0.2, -0.5])], "asset string, res string, ts timestamp, net_ret double")
    assert values(H.equity(df), "drawdown") == pytest.approx([0.0, 0.0, -0.5])


def test_stats_of_a_lost_equity_are_null(spark):
    df = spark.createDataFrame([("a", "1h", T0 + timedelta(hours=i), r, 1.0, 0.0) for i, r in enumerate([-2.0, 0.2])], "asset string, res string, ts timestamp, net_ret double, turnover double, cost double")
    row = H.return_stats(H.equity(df), 8760).first()
    assert row["annual"] is None and row["total"] == pytest.approx(-2.2)


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p_value double")
    got = {r["p_value"]: (r["p_bonferroni"], r["p_holm"]) for r in T.adjust_p(df).collect()}
    assert got[0.01] == pytest.approx((0.03, 0.03)) and got[0.03] == pytest.approx((0.09, 0.06)) and got[0.04] == pytest.approx((0.12, 0.06))


def test_permutation_draws_agree_with_the_exact_null(spark):
    df = spark.createDataFrame([("a", "1h", 400, 210, 190, 230)], "asset string, res string, n long, n_up long, n_pred_up long, hits long")
    drawn, exact = T.permutation_p(df, 4000).first(), T.exact_null(df).first()
    assert drawn["null_mean"] == pytest.approx(exact["null_mean"], abs=0.003) and drawn["null_std"] == pytest.approx(exact["null_std"], rel=0.06)
    assert drawn["p_value"] < 0.02


def walk(seed, n):
    rng = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x *= 1 + rng.choice([-0.01, 0.01, 0.004])
        out.append(x)
    return out


def test_no_look_ahead(spark):
    a, b = walk(1, 80), walk(1, 60) + walk(9, 20)
    cols = ["return_1h", "return_6h", "volatility", "trend_slope", "streak_signed", "streak_big"]
    one, two = (X.atom_pool(series(spark, x), patterns=True) for x in (a, b))
    assert values(one, *cols)[:60] == values(two, *cols)[:60]


def test_partitioning_and_order_do_not_matter(spark):
    bars = series(spark, walk(4, 120)).unionByName(series(spark, walk(5, 90), "b"))
    want = sorted(map(tuple, X.atom_pool(bars).select("asset", "ts", "return_6h", "streak_big").collect()))
    for n in (1, 7):
        got = X.atom_pool(bars.orderBy(F.rand(n)).repartition(n))
        assert sorted(map(tuple, got.select("asset", "ts", "return_6h", "streak_big").collect())) == want


def test_chunks_are_like_one_window(spark):
    bars = series(spark, walk(6, 300))
    plain = X.pct_return(bars, 6, name="r")
    cut = chunked(bars, lambda d, by: X.pct_return(d, 6, by, name="r"), 40, 6)
    assert values(cut, "r") == values(plain, "r")


def test_empty_tables(spark):
    empty = series(spark, [1.0]).where("false")
    assert X.atom_pool(empty).count() == 0
    assert R.asof_join(empty.select("asset", "ts"), empty.select("asset", "ts", "close")).count() == 0
    assert R.resample_ohlcv(empty, "4h").count() == 0
    assert P.fit_thresholds(empty, ["close"]).count() == 0


def test_late_ticks_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *hours: [("a", T0 + timedelta(hours=h), 1.0, 1, i) for i, h in enumerate(hours)]
    kind = "asset string, ts timestamp, price double, qty int, seq int"
    spark.createDataFrame(rows(0, 5, 6), kind).coalesce(1).write.parquet(str(src / "1"))
    read = lambda: ST.stream_bars(spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(src)), "1h", delay="1 hour")
    seen = []
    run = lambda: ST.each_batch(read(), lambda df, _: seen.extend(r["ts"].hour for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame(rows(1, 7, 20), kind).coalesce(1).write.parquet(str(src / "2"))
    run()
    spark.createDataFrame(rows(23), kind).coalesce(1).write.parquet(str(src / "3"))
    run()
    assert sorted(seen) == [0, 5, 6, 7, 20]


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.write_ledger(spark.createDataFrame([("a", "hit")], "asset string, outcome string"), path)
    S.write_ledger(spark.createDataFrame([("b", None)], "asset string, outcome string"), path)
    assert sorted((r["asset"], r["outcome"]) for r in S.read_ledger(spark, path).collect()) == [("a", "hit"), ("b", None)]
