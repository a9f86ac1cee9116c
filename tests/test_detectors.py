"""Rolling periods, best windows, zombies, rescues, rotation chains, the registry of detectors and the sweep, against brute force and golden wallets."""

import math
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapegrade.operators.rolling import rolling_periods, rolling_top
from tapegrade.operators.sweep import distinct_recent
from tapegrade.plans import books, catalog, detectors, rotation, statistics
from tapegrade.plans.dialect import Frames

from .test_core import FILL


def frames(spark, **tables):
    t = Frames(spark, "", catalog.VIEWS, built=catalog.BUILT)
    t.made |= tables
    return t


def fills(spark, rows):
    """(address, coin, day, dq, price, pnl) in dollars; each row is an order of its own."""
    return spark.createDataFrame([(a, c, d, d // 30, i, 1, 1, 1, abs(q), q, int(abs(q) * p * 10**6), int(p * 10**6), 0, int(n * 10**6), True, "N") for i, (a, c, d, q, p, n) in enumerate(rows)], FILL)


FLOW = "address long, id long, day int, month int, kind string, usdc_u long, flow_u long, priority string"
REGISTRY = "address long, name string, funder int, slot int, value_u long, role string, cluster long"


def flows(spark, rows):
    """(address, id, day, kind, dollars)."""
    sign = {"deposit": 1, "withdraw": -1}
    return spark.createDataFrame([(a, i, d, d // 30, k, int(u * 10**6), sign.get(k, 0) * int(u * 10**6), "1-URGENT") for a, i, d, k, u in rows], FLOW)


def registry(spark, values, role="user"):
    """address -> dollars beyond the base of 1,000,000."""
    return spark.createDataFrame([(a, f"n{a}", 1, 0, int(v * 10**6), role, a) for a, v in values.items()], REGISTRY)


@pytest.mark.parametrize("seed, days", [(1, 10), (2, 7), (3, 1), (4, 40)])
def test_periods_match_a_visit_of_every_row(spark, seed, days):
    rng = random.Random(seed)
    rows = [(k, d, rng.choice((0.0, rng.gauss(0, 0.1), rng.gauss(0, 0.1), -700.0 if rng.random() < 0.02 else 0.05)), rng.randrange(-9, 9)) for k in range(6) for d in sorted(rng.sample(range(-30, 90), rng.choice((1, 5, 60))))]
    df = spark.createDataFrame(rows, "k int, d int, g double, x long")
    got = {(r.k, r.d): r for r in rolling_periods(df, ["k"], "d", days, F.col("g"), {"x": F.col("x")}).collect()}
    assert len(got) == len(rows)
    for k, d, _, _ in rows:
        inside = [(g, x) for a, b, g, x in rows if a == k and d - days < b <= d]
        level, peak, fall = 0.0, 0.0, 0.0
        for g, _ in inside:
            level += g
            peak = max(peak, level)
            fall = max(fall, peak - level)
        r = got[k, d]
        assert math.isclose(r.fall, fall, abs_tol=1e-9) and math.isclose(r.growth, level, abs_tol=1e-9) and r.x == sum(x for _, x in inside) and r.rows == len(inside)
        assert r.whole == (d - days + 1 >= min(b for a, b, _, _ in rows if a == k))


def test_top_of_periods_matches_sorting(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(40), rng.randrange(-50, 80)) for k in range(3) for _ in range(60)]
    for r in rolling_top(spark.createDataFrame(rows, "k int, d int, v long"), ["k"], "d", 9, "v", 4).collect():
        inside = [v for k, d, v in rows if k == r.k and r.d - 9 < d <= r.d]
        assert (r.total, r.top) == (sum(inside), sum(sorted((v for v in inside if v > 0), reverse=True)[:4]))


def test_best_three_windows(spark):
    """The best three windows of seven days that do not touch, by all choices; addresses without profit pass."""
    rng = random.Random(6)
    rows = [(a, "X", c, c, d, rng.choice((-30, -10, 5, 20, 60)) * (1 if a else -1) - (5 if a == 0 else 0)) for a in range(6) for c, d in enumerate(sorted(rng.sample(range(60), 9 if a < 5 else 2)))]
    df = spark.createDataFrame([(a, c, t, d, int(n * 10**6)) for a, c, t, _, d, n in rows], "address long, coin string, trip long, close_day int, net_u long")
    got = {r.address: r for r in frames(spark, closed_trips=df).sql(catalog.TEXTS["d_c8"]).collect()}
    for a in range(6):
        own = [(d, n) for x, _, _, _, d, n in rows if x == a]
        ends = sorted({d for d, _ in own})
        value = {e: sum(n for d, n in own if e - 7 < d <= e) for e in ends}
        sets = [c for k in (0, 1, 2, 3) for c in combinations(ends, k) if all(y - x >= 7 for x, y in zip(c, c[1:]))]
        best, total = max(sum(value[e] for e in c) for c in sets), sum(n for _, n in own)
        assert got[a].best3 == best and got[a].total == total
        assert got[a].severity == ("FLAG" if total > 0 and best > 0.8 * total else "PASS")


def test_a_sweep_counts_as_a_self_join_does(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(2), rng.randrange(12), rng.randrange(600)) for _ in range(250)]
    df = spark.createDataFrame(rows, "k int, who int, t long")
    for slot in (None, 7, 61):
        found = distinct_recent(df, ["k"], "t", "who", 30, slot)
        got = {(r.k, r.t): r.addresses for r in found.collect()}
        assert got == {(k, t): len({w for a, w, u in rows if a == k and t - 30 <= u <= t}) for k, _, t in rows}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def zombie_book(spark, last=40):
    """Address 1 is 30 % of its equity under water for four days and more; 2 only for three; 3 holds a small loss for long."""
    marks = {d: 100 for d in range(last)} | {d: 60 for d in range(10, 15)} | {d: 60 for d in range(20, 24)}
    tape = [(9, "X", d, 10**9 if d % 2 else -(10**9), p, 0) for d, p in marks.items()]
    own = [(1, "X", 5, 8000, 100, 0), (1, "X", 16, -8000, 100, 0), (2, "X", 19, 8000, 100, 0), (2, "X", 30, -8000, 100, 0), (3, "X", 5, 1000, 100, 0), (3, "X", 30, -1000, 100, 0), (4, "X", 5, -8000, 60, 0)]
    return frames(spark, fills=fills(spark, own + tape), flows=flows(spark, []), registry=registry(spark, {1: 0, 2: 0, 3: 0, 4: 0, 9: 0}))


def test_zombies_last_more_than_three_days(spark):
    t = zombie_book(spark)
    # the shorts of 4 lose at 100; 2 is under water for three days, 3 with a twentieth of its equity
    got = {(r.address, r.first, r.last) for r in t["zombies"].collect()}
    assert got == {(1, 10, 14), (4, 5, 9), (4, 15, 19), (4, 24, 39)}
    verdict = {r.address: r.severity for r in t.sql(catalog.TEXTS["d_r2"]).collect()}
    assert verdict[1] == "VETO" and verdict[3] == "PASS" and verdict[2] == "PASS"


@pytest.mark.parametrize("width", [1, 5, 64])
def test_days_under_water_are_found_whatever_the_blocks(spark, width):
    t = zombie_book(spark)
    plain = frames(spark, **{k: t[k] for k in ("fills", "flows", "registry")})
    plain.built = {}
    rows = lambda df: Counter((r.address, r.coin, r.trip, r.day, round(r.share, 9)) for r in df.collect())
    want = rows(plain["underwater_days"])
    assert rows(books.underwater_days(t, width)) == want and len(want) > 20


def rescuer(spark, deposits, q=3000, mark=700, cut=()):
    """A long book of ``q`` at 1,000 with equity 1,000,000, marked down; deposits come after."""
    own = [(1, "X", 5, q, 1000, 0), *[(1, "X", d, -1, mark, 0) for d in cut]]
    tape = [(9, "X", d, 100_000 if d % 2 else -100_000, 1000 if d <= 5 else mark, 0) for d in range(1, 400)]
    return frames(spark, fills=fills(spark, own + tape), flows=flows(spark, [(1, i, d, "deposit", u) for i, (d, u) in enumerate(deposits)]), registry=registry(spark, {1: 0, 9: 0}))


def severity(t, key, address=1):
    return {r.address: r.severity for r in t.sql(catalog.TEXTS[key]).collect()}.get(address)


def test_rescues(spark):
    """uPnL of -900,000 on 1,000,000; two within 180 days are a veto, a cut or a small deposit is none."""
    assert severity(rescuer(spark, [(20, 200_000)]), "d_m2") == "FLAG"
    assert severity(rescuer(spark, [(20, 200_000), (120, 400_000)]), "d_m2") == "VETO"
    assert severity(rescuer(spark, [(20, 200_000), (320, 400_000)]), "d_m2") == "FLAG"
    assert severity(rescuer(spark, [(20, 200_000)], cut=(21,)), "d_m2") == "PASS"
    assert severity(rescuer(spark, [(20, 10_000)]), "d_m2") == "PASS"
    assert severity(rescuer(spark, [(20, 400_000)], mark=990), "d_m2") == "PASS"


def test_a_rescue_by_distance_alone(spark):
    """A loss of 5.6 % of equity, but the liquidation 8 % away."""
    t = rescuer(spark, [(20, 200_000)], q=9000, mark=993)
    r = t["rescues"].first()
    assert -0.25 < r.upnl_share < 0 and 0.05 < r.distance < 0.10 and severity(t, "d_m2") == "FLAG"


def chain(spark, nets, starts, moves):
    """Wallets 1, 2, ... with one trip each; ``moves`` are transfers (src, dst, day)."""
    rows = [x for a, (n, d) in enumerate(zip(nets, starts), 1) for x in ((a, "X", d, 1, 100, 0), (a, "X", d + 60, -1, 100, n))]
    transfers = spark.createDataFrame([(s, d, i, day, 0) for i, (s, d, day) in enumerate(moves)], "src long, dst long, id long, day int, usdc_u long")
    return frames(spark, fills=fills(spark, rows), flows=flows(spark, []), registry=registry(spark, {a: 0 for a in range(1, len(nets) + 1)}), all_transfers=transfers)


def test_three_wallets_in_a_row_are_one_book(spark):
    t = chain(spark, [-500_000, 100, 200, 50], [1, 40, 90, 300], [(1, 2, 35), (2, 3, 80), (3, 4, 200), (2, 1, 45)])
    got = {r.address: (r.root, r.depth, round(r.merged_u / 1e6), r.severity) for r in t["rotations"].collect()}
    # wallet 4 began 100 days after its transfer, and money sent back to 1 starts nothing
    assert got == {2: (1, 1, -499_700, "VETO"), 3: (1, 2, -499_700, "VETO")}
    good = chain(spark, [500, 100], [1, 40], [(1, 2, 35)])
    assert {r.address: r.severity for r in good["rotations"].collect()} == {2: "PASS"}


def test_long_chains_by_pointer_jumping(spark):
    n = 37
    t = chain(spark, [1] * n, [10 * k for k in range(1, n + 1)], [(k, k + 1, 10 * (k + 1) - 2) for k in range(1, n)])
    assert {(r.address, r.root, r.depth) for r in rotation.chains(t).collect()} == {(k, 1, k - 1) for k in range(1, n + 1)}


def test_the_registry_is_complete():
    codes = [d.code for d in detectors.REGISTRY]
    assert Counter(c[2] for c in codes) == {"M": 8, "H": 6, "R": 7, "C": 8, "B": 6} and len(set(codes)) == 35
    assert {d.evidence for d in detectors.REGISTRY} <= set(detectors._FACTS)


def test_results_follow_from_the_registered_queries(spark, sf):
    """Members' rows equal the detectors' own queries; a cluster's lifted rows are the worst of its members'; G10 passes nobody that has a veto."""
    t = catalog.frames(spark, sf)
    rows = t["results"].collect()
    by = {(r.entity, r.code): r for r in rows}
    # nobody rotates here, and no opposite opens come within a minute
    assert len(by) == len(rows) and {d.code for d in detectors.REGISTRY} - {r.code for r in rows} <= {"D-M7", "D-H5"}
    for key, code in (("d_c2", "D-C2"), ("d_r1_martingale", "D-R1"), ("d_r2", "D-R2"), ("d_m2", "D-M2"), ("d_b3", "D-B3"), ("d_c8", "D-C8")):
        for r in t.sql(catalog.TEXTS[key]).collect():
            assert by[r.address, code].severity == r.severity, (key, r)
    clusters = [r for r in rows if r.entity < 0]
    members = {}
    for r in t["cluster_of"].collect():
        members.setdefault(-1 - r.root, []).append(r.address)
    rank = {"PASS": 0, "INFO": 1, "FLAG": 2, "VETO": 3}
    for r in clusters:
        if r.code == "D-B3":
            assert rank[r.severity] == max(rank[by[m, "D-B3"].severity] for m in members[r.entity])
    assert {r.entity for r in clusters} == set(members)
    assert all((r.evidence is None) <= (r.severity == "PASS") or r.evidence is None for r in rows)
    assert all(r.penalty == (5 if r.severity == "FLAG" else 0) and len((r.evidence or "").split(";")) <= 3 for r in rows)
    vetoed = {r.entity for r in rows if r.severity == "VETO"}
    passed = {r.address for r in catalog.queries()["gates"](spark, sf).filter("g10").collect()}
    assert not passed & (vetoed | {m for c in vetoed if c < 0 for m in members[c]})


RESULT = "entity long, code string, severity string, penalty int, evidence string"


def policy(spark, found, links=()):
    """Verdicts from results given as (entity, code, severity)."""
    t = frames(spark, results=spark.createDataFrame([(*f, 5 if f[2] == "FLAG" else 0, None) for f in found], RESULT), registry=registry(spark, {a: 0 for a in (1, 2, 3, 4)}), cluster_of=spark.createDataFrame(list(links), "address long, root long"))
    return {r.address: (r.verdict, r.families, r.penalty) for r in t.sql(catalog.TEXTS["severity_policy"]).collect()}


def test_three_families_of_flags_need_a_look(spark):
    flags = [(1, c, "FLAG") for c in ("D-R6", "D-R5", "D-M1", "D-C7")] + [(2, c, "FLAG") for c in ("D-R1", "D-R2", "D-R3", "D-R5", "D-R6")] + [(3, "D-C4", "INFO"), (4, "D-C1", "PASS")]
    assert policy(spark, flags) == {1: ("needs_qa", 3, 20), 2: ("clean", 1, 15), 3: ("clean", 0, 0), 4: ("clean", 0, 0)}


def test_a_member_fails_with_its_cluster_and_leverage_counts_as_rescue(spark):
    got = policy(spark, [(-3, "D-H1", "VETO"), (1, "D-C1", "PASS"), (3, "D-M2", "FLAG"), (3, "D-M4", "FLAG"), (4, "D-M2", "FLAG")], [(1, 2), (2, 2)])
    assert {a: v[0] for a, v in got.items()} == {1: "vet_fail", 2: "vet_fail", 3: "vet_fail", 4: "clean"}


def test_all_stages_can_be_reached(spark):
    """A wallet for each stage, by what its tables say."""
    names = ["discovered", "screened_out", "light_ok", "reconcile_fail", "vet_fail", "reformed", "needs_qa", "deep_ok", "dropped", "forward_validated", "watch", "qualified"]
    n = len(names)
    rows = range(1, n + 1)
    board = spark.createDataFrame([(a, 100 if a != 2 else 0, 10_000 if a == 3 else 100) for a in rows if a != 1], "address long, vlm_all long, n_fills long")
    board = board.selectExpr("address", "vlm_all", "n_fills", "'user' AS role", "1 AS value_u", "100 AS active_days", "500 AS last", "0 AS first_day")
    gate = spark.createDataFrame([(a, a > 8, a == 6) for a in rows if a != 1], "address long, g boolean, genuine_late boolean").selectExpr("address", "genuine_late", *[f"g AS {x}" for x in catalog.screens.GATES])
    t = frames(
        spark, registry=registry(spark, {a: 0 for a in rows}), board=board, gate_rows=gate, day_stats=spark.createDataFrame([(a, 1, 1000) for a in rows], "address long, inflow_u long, net_u long"),
        reconciled=spark.createDataFrame([(a, "reconcile_fail" if a == 4 else "ok") for a in rows], "address long, verdict string"),
        verdicts=spark.createDataFrame([(a, a == 5, 3 if a == 7 else 0) for a in rows], "address long, vetoed boolean, families long"),
        forward=spark.createDataFrame([(a, 0 if a == 12 else 5, 10 if a in (11, 12) else 90, a == 9) for a in rows], "address long, acts long, days int, breached boolean"),
    )
    assert [r.stage for r in t.sql(catalog.TEXTS["stages"]).orderBy("address").collect()] == names


def test_a_screen_needs_all_of_its_metrics(spark):
    board = spark.createDataFrame([(1, 10**12, 0, 10**12, 10**12, 400, 0), (2, 10**12, 0, 10**12, 10**12, 400, 0)], "address long, value_u long, pnl_all long, vlm_all long, vlm_30 long, last_fill int, first_day int")
    stats = spark.createDataFrame([(1, 0.8, 50, 1.0)], "address long, win_rate double, n_trips long, median_hold double")
    risk = spark.createDataFrame([(1, 0.1), (2, 0.1)], "address long, max_dd double")
    got = {(r.screen, r.address) for r in frames(spark, board=board, trip_stats=stats, risk=risk).sql(catalog.TEXTS["screen_named"]).collect()}
    assert ("thirty_days", 1) in got and ("thirty_days", 2) not in got and ("recent", 2) in got


def test_exit_lag_has_no_end(spark):
    rng = random.Random(8)
    marks = {(c, d): rng.randrange(95, 110) if d != 190 else 50 for c in "XY" for d in sorted({*rng.sample(range(200), 60), 190})}
    cuts = [(a, c, d, p) for a, (c, d, p) in enumerate((c, rng.randrange(200), rng.randrange(40, 112)) for c in "XY" for _ in range(25))]
    legs = spark.createDataFrame([(a, c, 1, d, 0, 0, 0, 0, p * 10**6, False) for a, c, d, p in cuts], "address long, coin string, trip long, day int, ok long, ln int, sk long, pk long, px_u long, opens boolean")
    t = frames(spark, trip_legs=legs, marks=spark.createDataFrame([(c, d, p * 10**6) for (c, d), p in marks.items()], "coin string, day int, low_u long"))
    for width in (1, 32):
        got = {r.address: r.lag for r in catalog.links.exit_lag(t, width).collect()}
        want = {a: min(m - d for (k, m), low in marks.items() if k == c and m > d and low * 100 <= p * 99) for a, c, d, p in cuts if any(k == c and m > d and low * 100 <= p * 99 for (k, m), low in marks.items())}
        assert got == want and max(want.values()) > 60


def test_the_bootstrap_is_near_the_exact_value(spark):
    """Weights of three returns by all Poisson draws, against the resamples; many wallets of the same returns agree on average."""
    r = (0.02, -0.03, 0.015)
    chance = [math.exp(-1) / math.factorial(k) for k in range(12)]
    exact = sum(math.prod(chance[w] for w in ws) for ws in product(range(12), repeat=3) if sum(w * x for w, x in zip(ws, r)) <= 0)
    rows = spark.createDataFrame([(a, d, x) for a in range(40) for d, x in enumerate(r)] + [(99, 1, None)], "address long, day int, r double")
    got = statistics.bootstrap_p(frames(spark, returns=rows), 1000, rows_each=50).collect()
    assert {x.address for x in got} == set(range(40)) and all(abs(x.p_value - exact) < 0.08 for x in got) and abs(np.mean([x.p_value for x in got]) - exact) < 0.02
    assert sorted(map(tuple, got)) == sorted(map(tuple, statistics.bootstrap_p(frames(spark, returns=rows), 1000, rows_each=7).collect()))
    weights = statistics.resample_weights(np.arange(200), 0, 500)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03


def test_months_without_a_whole_tape_are_unknown(spark):
    """January has all days of the tape, February lacks ten, March has no trade of address 1."""
    days = [d for d in range(90) if not 35 <= d < 45]
    tape = [(9, "X", d, 1, 100, 0) for d in days] + [(1, "X", d, 1, 100, 5) for d in (3, 50)] + [(1, "X", 95, 1, 100, 5), *[(9, "X", d, 1, 100, 0) for d in range(90, 120)]]
    t = frames(spark, fills=fills(spark, tape).withColumn("month", F.expr("year(date_add(DATE '1970-01-01', day)) * 12 + month(date_add(DATE '1970-01-01', day)) - 1")), flows=flows(spark, []), registry=registry(spark, {1: 0, 9: 0}))
    first = 1970 * 12
    got = {r.month - first: (r.grade, r.coarse) for r in t.sql(catalog.TEXTS["month_grades"]).filter("address = 1").collect()}
    assert got == {0: ("genuine", False), 1: ("unknown", False), 2: ("inactive", False), 3: ("genuine", False)}
    assert t.sql(catalog.TEXTS["known_coverage"]).filter("address = 1").select("active", "unknown", "coverage").first() == (3, 1, 1.0)


def test_weights_of_resamples_are_looked_up_and_equal_the_search(monkeypatch):
    seeds, searched, search = np.concatenate([np.arange(-500, 500), np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 2000)]), [], np.searchsorted
    with np.errstate(over="ignore"):
        x = seeds.view(np.uint64)[:, None] + (np.arange(7, 107, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        want = search(statistics._POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: searched.append(np.size(v)) or search(a, v, *rest))
    assert (statistics.resample_weights(seeds, 7, 100) == want).all()
    assert sum(searched) < want.size // 1000


def test_every_detector_is_in_one_part_and_no_query_holds_them_all():
    found = [code for text in detectors.PARTS.values() for code in re.findall(r"AS entity, '(D-\w+)' AS code|entity, '(D-\w+)' AS code", text)]
    found = sorted(a or b for a, b in found)
    assert found == sorted(d.code for d in detectors.REGISTRY)
    assert max(text.count("' AS code, severity FROM") for text in detectors.PARTS.values()) < 10
    assert not any("AS code" in text for text in detectors.PARTS["evidence"].split("UNION ALL"))


def test_inflows_of_a_day_meet_the_book_once(spark):
    days = [(a, i, 1 + i % 3, "withdraw" if i % 5 == 0 else "deposit", 100 + i) for a in (1, 2) for i in range(a * 100, a * 100 + 40)]
    made = {
        "flows": flows(spark, [*days, (1, 101, 3, "deposit", 7)]),  # a number that two rows have
        "returns": spark.createDataFrame([(a, d, 10**12 + d) for a in (1, 2) for d in range(1, 4)], "address long, day int, start_u long"),
        "open_books": spark.createDataFrame([(1, "x", 1, 0, 5, 3.0, 2), (1, "y", 1, 1, -2, 4.0, 9), (2, "x", 1, 2, 7, 1.5, 3), (2, "y", 1, 3, 9, 1.0, 9)], "address long, coin string, trip long, day int, q long, cost double, until int"),
        "daily_marks": spark.createDataFrame([(c, d, (2 + d) * 10**6) for c in "xy" for d in range(5)], "coin string, day int, vwap_u long"),
    }
    got, text = frames(spark, **made)["inflow_states"], Frames(spark, "", catalog.VIEWS)
    text.made |= made
    assert sorted(got.collect()) == sorted(text["inflow_states"].collect()) and got.count() > 40
    tree = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    met = next(i for i, line in enumerate(tree) if "until" in line and "Join Inner" in line)
    assert "Aggregate [address" in tree[met + 1] and ", day" in tree[met + 1], tree[met : met + 2]


def test_gates_are_judged_without_a_chain_of_joins(spark, sf):
    """The same rows as by the text's joins, with at most one join in the query that makes them."""
    base = catalog.judged(spark, sf)
    made = dict(base.made)
    got = base["gate_rows"]
    plain = Frames(spark, sf, catalog.VIEWS, built={k: v for k, v in catalog.BUILT.items() if k != "gate_rows"})
    plain.made |= made
    want = plain["gate_rows"]
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    assert base["gate_sides"]._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
