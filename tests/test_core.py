"""Helpers against brute force, invariants of the position engine, golden wallets, and the catalogue's plumbing."""

import datetime
import math
import random
import re
from fractions import Fraction
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapegrade.operators.graph import connected_components
from tapegrade.operators.joins import asof_join, band_join, islands
from tapegrade.operators.pairs import shared_moments, shared_sums
from tapegrade.operators.rolling import rolling_periods
from tapegrade.plans import catalog, links, statistics
from tapegrade.plans.dialect import Frames, oracle, translate


def pairs(rng, n, keys=3, span=100):
    return [(i, rng.randrange(keys), rng.randrange(-span, span)) for i in range(n)]


@pytest.mark.parametrize("low,high", [(0, 5), (-7, 3), (4, 20), (0, 0)])
def test_band_join_matches_brute_force(spark, low, high):
    rng = random.Random(low * 31 + high)
    a, b = pairs(rng, 60), pairs(rng, 60)
    left, right = spark.createDataFrame(a, "i int, k int, t long"), spark.createDataFrame(b, "j int, k int, u long")
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and low <= y[2] - x[2] <= high}
    got = band_join(left, right, ["k"], "t", "u", low, high).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    met = {i for i, _ in want}
    assert sorted(r[0] for r in band_join(left, right, ["k"], "t", "u", low, high, "left_semi").collect()) == sorted(met)
    assert sorted(r[0] for r in band_join(left, right, ["k"], "t", "u", low, high, "left_anti").collect()) == sorted({x[0] for x in a} - met)


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(7)
    a, b = pairs(rng, 80), [(i, k, t) for (k, t), i in {(k, t): i for i, k, t in pairs(rng, 40)}.items()]
    got = asof_join(spark.createDataFrame(a, "i int, k int, t long"), spark.createDataFrame(b, "v int, k int, t long"), ["k"], "t", ["v"]).collect()
    for r in got:
        before = [(y[2], y[0]) for y in b if y[1] == r["k"] and y[2] <= r["t"]]
        assert r["v"] == (max(before)[1] if before else None)
    assert len(got) == 80


@pytest.mark.parametrize("block", [1, 3, 512])
def test_shared_moments_match_brute_force(spark, block):
    """With a key that all act in, days before zero, nulls and repeated rows, whatever the blocks."""
    rng = random.Random(block)
    rows = [(w, rng.choice("aaaab"), rng.randrange(-70, 70)) for w in range(25) for _ in range(rng.randrange(0, 40))]
    rows += rows[:30] + [(None, "a", 1), (3, None, 1), (4, "a", None)]
    acted = {}
    for w, k, at in rows:
        if None not in (w, k, at):
            acted.setdefault(w, set()).add((k, at))
    want = {(a, b): len(acted[a] & acted[b]) for a in acted for b in acted if a < b and len(acted[a] & acted[b]) >= 3}
    df = spark.createDataFrame(rows, "who long, k string, at long")
    for width in (1, 7, 32, None):
        got = {(r["src"], r["dst"]): r["n"] for r in shared_moments(df, "who", ["k"], "at", 3, block, width).collect()}
        assert got == want and len(want) > 20
    assert shared_moments(df.limit(0), "who", ["k"], "at", 1).count() == 0


@pytest.mark.parametrize("blocks, chunk", [(None, 1_000), (1, 1), (4, 7), (9, 1_000)])
def test_shared_sums_match_brute_force(spark, blocks, chunk):
    """With a key that all act in, days before zero, nulls, large values, and one who acts at every moment, whatever the blocks and chunks."""
    rng = random.Random(blocks or 0)
    acted = {w: {(rng.choice("aaaab"), rng.randrange(-70, 70)): rng.choice((0, -3, 5, 1 << 20)) for _ in range(rng.randrange(0, 40))} for w in range(-10, 15)}
    acted[99] = {(k, at): at for k in "ab" for at in range(-70, 70)}
    rows = [(w, k, at, v) for w, of in acted.items() for (k, at), v in of.items()]
    df = spark.createDataFrame(rows + [(None, "a", 1, 1), (3, None, 1, 1), (4, "a", None, 1), (4, "z", 1, None)], "who long, k string, at int, v long")
    want = {}
    for a in acted:
        for b in acted:
            both = [(acted[a][c], acted[b][c]) for c in acted[a].keys() & acted[b].keys()]
            if a < b and len(both) >= 3:
                want[a, b] = (len(both), sum(x for x, _ in both), sum(y for _, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both), sum(x * y for x, y in both))
    got = [tuple(r) for r in shared_sums(df, "who", ["k"], "at", "v", 3, chunk=chunk, blocks=blocks).collect()]
    assert len(got) == len(want) > 40 and {r[:2]: r[2:] for r in got} == want
    assert shared_sums(df.limit(0), "who", ["k"], "at", "v", 3).count() == 0


def test_opposed_pairs_are_not_shuffled(spark, sf):
    plan, text = catalog.PLANS["anti_corr_pairs"]
    assert "src" not in " ".join(re.findall(r"Exchange hashpartitioning[(]([^)]*)", plan(catalog.stored(spark, sf, text))._jdf.queryExecution().executedPlan().toString()))


def test_opposed_books_by_day(spark, sf):
    """The pairs of a plain self-join on a denser book: two that mirror each other, one that follows, one with two common days."""
    moves = {1: [5, -3, 4, -6, 2], 2: [-5, 3, -4, 6, -2], 3: [5, -2, 4, -6, 3], 4: [-9, 9], 5: [1, 1, 1, 1, 1]}
    t = catalog.frames(spark, sf)
    t.made["net_days"] = spark.createDataFrame([(a, "BTC", 30 + d, q) for a, qs in moves.items() for d, q in enumerate(qs)], "address long, coin string, day int, dq long")
    plan, text = catalog.PLANS["anti_corr_pairs"]
    got = sorted(map(tuple, plan(t).collect()))
    assert got == sorted(map(tuple, t.sql(text).collect())) and [g[:3] for g in got] == [(1, 2, 5), (2, 3, 5)]


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_islands(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8, 20)], "k string, t long")
    assert sorted((r["first"], r["last"], r["length"]) for r in islands(df, ["k"], "t").collect()) == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]


FILL = "address long, coin string, day int, month int, ok long, ln int, sk long, pk long, sz long, dq long, notional_u long, px_u long, fee_u long, pnl_u long, crossed boolean, flag string"


def book(spark, fills):
    """Frames over hand-made fills: (address, coin, day, dq, price, fee, pnl)."""
    rows = [(a, c, d, d // 30, i, 1, 1, 1, abs(q), q, abs(q) * p * 10**6, p * 10**6, int(f * 10**6), int(n * 10**6), True, "N") for i, (a, c, d, q, p, f, n) in enumerate(fills)]
    t = Frames(spark, "", catalog.VIEWS)
    t.made["fills"] = spark.createDataFrame(rows, FILL)
    return t


def test_martingale_wallet(spark):
    t = book(spark, [(1, "X", 1, 1, 100, 0, 0), (1, "X", 2, 2, 90, 0, 0), (1, "X", 3, 4, 80, 0, 0), (1, "X", 4, -7, 95, 0, 65), (2, "X", 1, 1, 100, 0, 0), (2, "X", 2, -1, 95, 0, -5)])
    got = {r["address"]: (r["n_martingale"], r["severity"]) for r in t.sql(catalog.TEXTS["d_r1_martingale"]).collect()}
    assert got == {1: (1, "VETO"), 2: (0, "PASS")}


def test_sign_flip_is_two_trips(spark):
    t = book(spark, [(1, "X", 1, 3, 10, 0, 0), (1, "X", 2, -5, 12, 1.0, 6), (1, "X", 3, 2, 11, 0, 2)])
    got = sorted((r["side"], r["max_size"], r["pnl"], r["fees"]) for r in t.sql(catalog.TEXTS["round_trips"]).collect())
    assert got == [("long", 3, 6.0, 0.6), ("short", 2, 2.0, 0.4)]


def test_gini_of_known_wins(spark):
    t = book(spark, [x for i, w in enumerate((1, 2, 4, 10)) for x in ((1, "X", 2 * i, 1, 10, 0, 0), (1, "X", 2 * i + 1, -1, 10, 0, w))])
    assert t.sql(catalog.TEXTS["gini"]).first()["gini"] == 0.426471


def test_lottery_wallet(spark):
    t = book(spark, [x for i, w in enumerate((50, -10, 20, -10, 30)) for x in ((1, "X", 2 * i, 1, 10, 0, 0), (1, "X", 2 * i + 1, -1, 10, 0, w))])
    r = t.sql(catalog.TEXTS["edge_metrics"]).first()
    assert (r["profit_factor"], r["payoff"], r["win_rate"]) == (5.0, 3.333333, 0.6)


def test_random_books_keep_their_invariants(spark):
    """No position jumps; trip pnl at average cost plus open result equals the mark to market."""
    rng = random.Random(11)
    fills, state, marked = [], {}, {}
    for i in range(400):
        key, q, p = (rng.randrange(5), rng.choice("XY")), rng.choice([-3, -2, -1, 1, 2, 3]), rng.randrange(50, 150)
        pos, cost, cash = state.get(key, (0, Fraction(0), Fraction(0)))
        close = min(abs(q), abs(pos)) if pos * q < 0 else 0
        pnl = close * (p - cost) * (1 if pos > 0 else -1)
        after = pos + q
        cost = Fraction(p) if pos * after <= 0 else cost if close else (abs(pos) * cost + abs(q) * p) / abs(after)
        state[key] = (after, cost, cash + pnl)
        marked[key] = marked.get(key, Fraction(0)) - q * p
        fills.append((key[0], key[1], i, q, p, 0, 0))
    for key, (pos, cost, cash) in state.items():
        assert cash + pos * (100 - cost) == marked[key] + pos * 100
    t = book(spark, fills)
    assert t.sql(catalog.TEXTS["continuity"]).agg(F.sum("breaks")).first()[0] == 0
    last = {}
    for r in t.sql(catalog.TEXTS["avg_cost"]).orderBy("day", "leg").collect():
        last[r["address"], r["coin"]] = r["avg_cost"]
    for key, (pos, cost, _) in state.items():
        if pos:
            assert math.isclose(last[key], float(cost), abs_tol=2e-3)
    ends = {(r["address"], r["coin"]): r["pos"] for r in t["positions"].groupBy("address", "coin").agg(F.max_by("pos", "day").alias("pos")).collect()}
    assert ends == {k: v[0] for k, v in state.items()}


def test_deposits_do_not_move_the_return(spark):
    t = Frames(spark, "", catalog.VIEWS)
    t.made["equity"] = spark.createDataFrame([(1, 1, 0, 0, 50_000_000, 150_000_000), (1, 5, 0, 0, -30_000_000, 120_000_000)], "address long, day int, month int, net_u long, flow_u long, equity_u long")
    assert [r["r"] for r in t["returns"].collect()] == [0.0, 0.0]
    assert t["day_stats"].first()["twr"] == 0.0


def test_flow_adjusted_path(spark):
    t = Frames(spark, "", catalog.VIEWS)
    rows = [(1, 1, 0, 10, 0, 110), (1, 2, 0, 5, 50, 165), (1, 3, 0, -16, 0, 149)]
    t.made["equity"] = spark.createDataFrame([(a, d, m, n * 10**6, f * 10**6, e * 10**6) for a, d, m, n, f, e in rows], "address long, day int, month int, net_u long, flow_u long, equity_u long")
    got = [round(r["r"], 6) for r in t["returns"].orderBy("day").collect()]
    assert got == [0.1, 0.037037, round(-16 / 165, 6)]
    assert round(t["risk"].first()["max_dd"], 6) == round(16 / 165, 6)


def test_drained_streams_equal_the_batch(spark, sf):
    import bisect

    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("coin"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2).alias("side"))
    days = rows.groupBy(F.date_trunc("day", "ts").alias("day"), "coin").agg(F.count("*").alias("n"))
    order = lambda found: sorted(map(tuple, found), key=str)
    assert order(catalog.queries()["stream_daily"](spark, sf).select("day", "coin", "n").collect()) == order(days.collect())
    by, want = {}, set()
    for r in rows.withColumn("us", F.unix_micros("ts")).collect():
        by.setdefault((r["coin"], r["side"]), []).append((r["us"], r["address"]))
    for (coin, side), acts in by.items():
        acts.sort()
        for at, address in acts:
            near = acts[bisect.bisect_left(acts, (at,)) : bisect.bisect_left(acts, (at + 900_000_001,))]
            if len({a for _, a in near}) > 1:
                want.add((at, coin, side, len({a for _, a in near})))
    got = catalog.queries()["stream_flocks"](spark, sf).select(F.unix_micros("start"), "coin", "side", "addresses").collect()
    assert order(got) == order(want) and want


@pytest.mark.parametrize("text, value", [
    ("DIV(10 + 3, 7)", 1), ("DIV(20 - 1, 3 + 2)", 3), ("20 + DIV(41 + 19, 20)", 23), ("DIV(DIV(100, 7), 1 + 1)", 7), ("MONTHNUM(DATE '2024-03-05')", 24290), ("DAYNUM('1970-02-01')", 31),
    ("DOW(DATE '2024-03-04')", 0), ("(SELECT max(x) FROM (SELECT SEQ(1, CASE WHEN 1 < 2 THEN 4 ELSE 0 END) AS x) t)", 4), ("(SELECT SUMI(x) FROM (SELECT 2 AS x UNION ALL SELECT 5) t)", 7),
    ("(SELECT JOINED(x) FROM (SELECT 'b' AS x UNION ALL SELECT 'a') t)", "a,b"), ("$max_dd * 2", 0.6), ("MONTHDATE(24290)", datetime.date(2024, 3, 1)), ("DAYDATE(31)", datetime.date(1970, 2, 1)),
])
def test_macros_by_value(spark, text, value):
    import duckdb

    for got in (spark.sql(translate(f"SELECT {text} AS v", False)).first()[0], duckdb.sql(translate(f"SELECT {text} AS v", True)).fetchall()[0][0]):
        got = got.date() if isinstance(got, datetime.datetime) else got
        assert got == pytest.approx(value) if isinstance(value, float) else got == value


def test_normal_quantile(spark):
    upper = [0.5, 0.4, 0.1, 0.03, 0.02, 1 / 1500, 1 / (1500 * math.e), 1e-9]
    got = [spark.sql(translate(f"SELECT {statistics.quantile(f'{u:.18f}')} AS z", False)).first()[0] for u in upper]
    assert got == pytest.approx([NormalDist().inv_cdf(1 - u) for u in upper], rel=1e-6, abs=1e-9)


def test_a_lost_account_stays_lost():
    """Daily returns of 0.1, -1.2 and 0.1 leave nothing: the index is zero from the second day on, in both engines' text."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE returns AS SELECT * FROM (VALUES (1, 1, 0, 100, 0, 10, 100, 0.1), (1, 2, 0, 10, 0, -90, 100, -1.2), (1, 3, 0, 11, 0, 1, 10, 0.1), (2, 1, 0, 1, 0, 1, 1, 0.5)) t(address, day, month, equity_u, flow_u, net_u, start_u, r)")
    text = lambda name: translate(catalog.VIEWS[name], True).replace("{", "").replace("}", "")
    assert [round(x[0], 9) for x in con.execute(f"SELECT idx FROM ({text('twr_curve')}) ORDER BY address, day").fetchall()] == [1.1, 0, 0, 1.5]
    assert [round(x[0], 9) for x in con.execute(f"SELECT twr FROM ({text('day_stats')}) ORDER BY address").fetchall()] == [-1, 0.5]


def test_twins_across_a_minute_edge():
    """Opposite opens 20 s apart count although the clock's minute changes; other sizes, sides and distances don't."""
    import duckdb

    con = duckdb.connect()
    rows = [(1, 59_000, 0, 100), (2, 79_000, 1, 110), (3, 60_500, 0, 100), (4, 59_500, 1, 200), (5, 200_000, 1, 100)]
    con.execute("CREATE TABLE actions (address BIGINT, ms BIGINT, side INT, notional_u BIGINT, coin VARCHAR)")
    con.executemany("INSERT INTO actions VALUES (?, ?, ?, ?, 'X')", rows)
    text = translate(catalog.TEXTS["d_h5"], True).replace("{", "").replace("}", "")
    assert sorted(con.execute(f"SELECT address, most FROM ({text})").fetchall()) == [(1, 1), (2, 1), (3, 1)]


def test_weeks_are_weeks(spark, sf):
    rows = catalog.queries()["weekly_coverage"](spark, sf).collect()
    days = catalog.queries()["positions"](spark, sf).selectExpr("max(day) - min(day)").first()[0]
    assert 0 < max(r["weeks"] for r in rows) <= days // 7 + 2


def test_every_query_has_sql_or_is_known_not_to():
    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert missing == {"bootstrap_p", "stream_daily", "stream_flocks", "stream_triggers", "stream_states", "stream_forward", "stream_revet"}
    assert all("{" not in s.replace("{}", "") for s in catalog.oracle_sql().values())


def test_oracle_orders_its_views():
    sql = oracle(catalog.TEXTS["round_trips"], catalog.VIEWS)
    at = [sql.index(f"{n} AS (") for n in ("fills", "positions", "legs", "trip_legs", "trips")]
    assert at == sorted(at)


@pytest.mark.parametrize("name", ["round_trips", "twr", "asof_mark", "flock", "clusters", "gates", "stream_positions", "ranking", "d_m2"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "supplier", "events", "pages", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
    plain = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got) == plain(want) and got


def test_sums_of_periods_keep_the_digits_of_small_rows_after_a_large_one(spark):
    """differences of sums over the whole record lose what a period's small rows add."""
    values = [1e9, *[1e-9 * (k % 7 + 1) for k in range(80)]]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "address long, day long, v double")
    got = {r.day: (r.s, r.growth) for r in rolling_periods(df, ["address"], "day", 10, F.col("v"), {"s": F.col("v")}).collect()}
    for day in range(10, 81):
        want = sum(values[day - 9 : day + 1])
        assert got[day] == (pytest.approx(want, rel=1e-12), pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("ids", ["own", "repeated", "null"])
def test_copiers_count_an_open_once_and_shuffle_pairs_once(spark, ids):
    """each open meets a leader once, so no pair is shuffled for its distinct ids; repeated ids still count once."""
    rng = random.Random(14)
    rows = [(None if ids == "null" and i % 5 == 0 else i // 2 if ids == "repeated" else i, rng.randrange(4), rng.randrange(600_000), rng.choice("XY"), rng.randrange(2)) for i in range(200)]
    t = catalog.frames(spark, "")
    t.made["actions"] = spark.createDataFrame(rows, "id long, address long, ms long, coin string, side int").withColumn("notional_u", F.lit(1).cast("long"))
    low, high = t.config.copier_low_s * 1000, t.config.copier_high_s * 1000
    met = {}
    for i, b, at, coin, side in rows:
        for _, a, before, other, same in rows:
            if i is not None and a != b and (coin, side) == (other, same) and low <= at - before <= high:
                met.setdefault((b, a), set()).add(i)
    want = {b: min((-len(x), a) for (of, a), x in met.items() if of == b) for b in {b for b, _ in met}}
    found = links.d_b4_copier(t)
    assert {r.address: (-r.n, r.leader) for r in found.collect()} == want
    if ids == "own":
        assert "distinct" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_large_cluster_does_not_overflow(spark):
    """exposure summed over a large cluster's days, and a price times the size of its trip, exceed 64 bits."""
    t = catalog.frames(spark, "")
    days = [(1, "X", d, 10 + d, 4 * 10**18) for d in range(5)]
    t.made["states"] = spark.createDataFrame(days, "address long, coin string, day int, szi long, exposure_u long")
    t.made["returns"] = spark.createDataFrame([(1, d, 0.01 * d) for d in range(5)], "address long, day int, r double")
    t.made["market"] = spark.createDataFrame([(d, 0.02 * d) for d in range(5)], "day int, r double")
    assert [(r.net_to_gross, r.beta) for r in t.sql(catalog.TEXTS["d_h2_style"]).collect()] == [(1.0, 0.5)]
    legs = [(1, "X", 1, d, d, 1, 1, 1, 0, px, q, before, before + q, opens) for d, (px, q, before, opens) in enumerate([(10**9, 10**8, 0, True), (10**11, 1, 10**8, True), (10**9, -(10**8) - 1, 10**8 + 1, False)])]
    t.made["trip_legs"] = spark.createDataFrame(legs, "address long, coin string, trip long, day int, ok long, ln int, sk long, pk long, leg int, px_u long, q long, before_q long, after_q long, opens boolean")
    assert [tuple(r) for r in t.sql(catalog.TEXTS["d_r1_martingale"]).collect()] == [(1, 1, 0, "PASS")]
