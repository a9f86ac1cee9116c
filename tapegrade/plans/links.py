"""Queries that need band joins, as-of joins and graphs: links between addresses and state at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrade.operators.graph import connected_components
from tapegrade.operators.joins import asof_join, band_join
from tapegrade.operators.pairs import shared_sums
from tapegrade.operators.sweep import distinct_recent
from tapegrade.plans.dialect import Frames


def asof_mark(t: Frames) -> DataFrame:
    """Exposure and unrealised result at each deposit, from the last state not later."""
    state = t["account_states"].select("address", "day", "exposure_u", "upnl_u")
    found = asof_join(t["flows"].filter("kind = 'deposit'").select("address", "id", "day", "usdc_u"), state, ["address"], "day", ["exposure_u", "upnl_u"])
    return found.select("address", "id", "day", "usdc_u", "exposure_u", "upnl_u")


#: Deposits (or transfers) into a book under water or near its liquidation, without a cut within a day; two within the span are a veto. {events} of
#: an address are counted by the largest number within the span.
RESCUE = """
    SELECT b.address, coalesce(r.events, 0) AS events, CASE WHEN coalesce(r.near, false) THEN 'VETO' WHEN r.events > 0 THEN 'FLAG' ELSE 'PASS' END AS severity FROM (SELECT DISTINCT address FROM {flows}) b LEFT JOIN (
      SELECT address, count(*) AS events, bool_or(coalesce(day - before <= $rescue_span, false)) AS near FROM (
        SELECT address, day, lag(day) OVER (PARTITION BY address ORDER BY day, id) AS before FROM {rescues} WHERE kind = '%s') e GROUP BY address) r ON b.address = r.address"""


def _actions(t: Frames, suffix: str) -> DataFrame:
    return t["actions"].select("coin", *[F.col(c).alias(f"{c}_{suffix}") for c in ("id", "address", "ms", "side", "notional_u")])


def behavioural_links(t: Frames) -> DataFrame:
    """Opposite opens on one coin within a minute, of like size; linked from the configured number on."""
    a, b, c = _actions(t, "a"), _actions(t, "b"), t.config
    size = F.col("notional_u_b").between((1 - c.twin_notional) * F.col("notional_u_a"), (1 + c.twin_notional) * F.col("notional_u_a"))
    met = band_join(a, b, ["coin"], "ms_a", "ms_b", 0, c.twin_seconds * 1000, residual=(F.col("address_a") != F.col("address_b")) & (F.col("side_a") != F.col("side_b")) & size)
    pairs = met.groupBy(F.least("address_a", "address_b").alias("src"), F.greatest("address_a", "address_b").alias("dst")).agg(F.count("*").alias("n"))
    return pairs.withColumn("linked", F.col("n") >= c.twin_events)


def d_b4_copier(t: Frames) -> DataFrame:
    """Share of an address' opens that follow one leader on the same side within the copier's lag.

    An open meets only the last of a leader's actions that it follows, so opens are counted as they meet: distinct ones would be shuffled twice, and are counted only where ids repeat.
    """
    c = t.config
    low = c.copier_low_s * 1000
    repeated = t["actions"].groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    after = F.lead("ms_a").over(W.partitionBy("coin", "side_a", "address_a").orderBy("ms_a", "id_a"))
    leaders = _actions(t, "a").withColumn("after_a", after).select("coin", "side_a", "address_a", "ms_a", "after_a")
    last = F.col("after_a").isNull() | (F.col("after_a") > F.col("ms_b") - low)
    met = band_join(leaders, _actions(t, "b").drop("notional_u_b"), ["coin"], "ms_a", "ms_b", low, c.copier_high_s * 1000, residual=(F.col("address_a") != F.col("address_b")) & (F.col("side_a") == F.col("side_b")) & last)
    followed = met.groupBy(F.col("address_b").alias("address"), F.col("address_a").alias("leader")).agg((F.countDistinct if repeated else F.count)("id_b").alias("n"))
    # the leader followed most; of equals, the smallest
    best = followed.groupBy("address").agg(F.max(F.struct("n", -F.col("leader"))).alias("m")).select("address", F.col("m.n").alias("n"), (-F.col("m.col2")).alias("leader"))
    opens = t["actions"].groupBy("address").agg(F.count("*").alias("opens"))
    share = F.col("n") / F.col("opens")
    flag = (share >= c.copier_share) & (F.col("opens") >= c.copier_opens)
    return best.join(opens, "address").select("address", "leader", "n", F.round(share, 6).alias("share"), F.when(flag, "FLAG").otherwise("PASS").alias("severity"))


def flock(t: Frames) -> DataFrame:
    """Moments at which several addresses have acted on one coin and side within the last quarter of an hour."""
    return distinct_recent(t["actions"], ["coin", "side"], "ms", "address", t.config.flock_s * 1000).filter("addresses >= 2")


def exit_lag(t: Frames, width: int = 32) -> DataFrame:
    """Days from the first cut of a closed trip to the first later mark one percent below the price of that cut, however late.

    The search goes by blocks of days: the first block after the cut's own whose lowest mark is low enough holds the day, unless the rest of the
    cut's own block does. Per coin there are few blocks, and a running minimum from the end of each block on drops cuts that no mark follows.
    """
    cuts = t["trip_legs"].filter("NOT opens").groupBy("address", "coin", "trip").agg(F.min(F.struct("day", "ok", "ln", "sk", "pk", "px_u")).alias("c")).select("address", "coin", "trip", F.col("c.day").alias("cut"), F.col("c.px_u").alias("px_u"))
    marks = t["marks"].select("coin", F.col("day").alias("mark_day"), "low_u").withColumn("block", F.floor(F.col("mark_day") / width))
    low = (F.col("low_u") * 100 <= F.col("px_u") * 99) & (F.col("mark_day") > F.col("cut"))
    own = cuts.withColumn("block", F.floor(F.col("cut") / width)).join(marks, ["coin", "block"]).filter(low)
    own = own.groupBy("address", "coin", "trip").agg(F.min(F.col("mark_day") - F.col("cut")).alias("lag"))
    lows = marks.groupBy("coin", "block").agg(F.min("low_u").alias("least"))
    rest = cuts.join(own, ["address", "coin", "trip"], "left_anti")
    first = rest.join(lows, "coin").filter((F.col("block") > F.floor(F.col("cut") / width)) & (F.col("least") * 100 <= F.col("px_u") * 99))
    first = first.groupBy("address", "coin", "trip", "cut", "px_u").agg(F.min("block").alias("block"))
    later = first.join(marks, ["coin", "block"]).filter(low).groupBy("address", "coin", "trip").agg(F.min(F.col("mark_day") - F.col("cut")).alias("lag"))
    return own.unionByName(later)


def clusters(t: Frames) -> DataFrame:
    """Components over hard links (subaccounts of one slot) and transfer links."""
    roots = connected_components(t["link_edges"].select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return roots.groupBy("root").agg(F.count("*").alias("members"), F.max("node").alias("last_member")).select(F.col("root").alias("cluster_id"), "members", "last_member")


#: Correlations from the sums of {common}: whole numbers, so nothing is rounded before the last step.
OPPOSED = """
    SELECT src, dst, n, round(rho, 4) AS rho FROM (SELECT src, dst, n, (d * sab - x * y) / (sqrt(d * saa - x * x) * sqrt(d * sbb - y * y)) AS rho FROM (
      SELECT src, dst, n, CAST(n AS DOUBLE) AS d, CAST(sa AS DOUBLE) AS x, CAST(sb AS DOUBLE) AS y, saa, sbb, sab FROM {common}) s WHERE d * saa > x * x AND d * sbb > y * y) c WHERE round(rho, 6) <= $opposed_rho"""


def anti_corr_pairs(t: Frames) -> DataFrame:
    """Addresses whose changes of position run against each other, over the days and coins that both traded; pairs are summed where they meet, and only those that meet often leave."""
    t.made["common"] = shared_sums(t.keep("net_days")["net_days"], "address", ["coin"], "day", "dq", t.config.opposed_days)
    return t.sql(OPPOSED)


def inflow_states(t: Frames) -> DataFrame:
    """The account before each inflow: a day's open positions are met and marked once, however many inflows the day has.

    The book of a large cluster has many inflows a day; each of them would meet every position that the cluster ever held.
    """
    return t.sql("""
        SELECT f.address, f.id, f.day, f.kind, f.usdc_u, r.start_u + p.upnl_u AS own_u, p.upnl_u, p.exposure_u FROM {flows} f JOIN {returns} r ON f.address = r.address AND f.day = r.day JOIN (
          SELECT f.address, f.id, sum(d.upnl_u) AS upnl_u, SUMI(d.exposure_u) AS exposure_u FROM {flows} f JOIN (
            SELECT a.address, a.day, sum(b.q * (m.vwap_u - b.cost * 1e6)) AS upnl_u, SUMI(abs(b.q) * m.vwap_u) AS exposure_u
            FROM (SELECT DISTINCT address, day FROM {flows} WHERE kind <> 'withdraw') a JOIN {open_books} b ON a.address = b.address AND a.day > b.day AND a.day <= b.until JOIN {daily_marks} m ON b.coin = m.coin AND a.day = m.day GROUP BY a.address, a.day) d
          ON f.address = d.address AND f.day = d.day WHERE f.kind <> 'withdraw' GROUP BY f.address, f.id) p ON f.address = p.address AND f.id = p.id
        WHERE f.kind <> 'withdraw'""")


#: Views with a plan of their own.
BUILT = {"inflow_states": inflow_states}

#: name -> (DataFrame plan, oracle text)
PLANS = {
    "anti_corr_pairs": (anti_corr_pairs, """
        SELECT a.address AS src, b.address AS dst, count(*) AS n, round(CORR(a.dq, b.dq), 4) AS rho FROM {net_days} a JOIN {net_days} b ON a.coin = b.coin AND a.day = b.day AND a.address < b.address
        GROUP BY a.address, b.address HAVING count(*) >= $opposed_days AND var_pop(a.dq) > 0 AND var_pop(b.dq) > 0 AND round(CORR(a.dq, b.dq), 6) <= $opposed_rho"""),
    "asof_mark": (asof_mark, """
        SELECT f.address, f.id, f.day, f.usdc_u, s.exposure_u, s.upnl_u FROM (SELECT * FROM {flows} WHERE kind = 'deposit') f
        ASOF LEFT JOIN {account_states} s ON f.address = s.address AND f.day >= s.day"""),
    "behavioural_links": (behavioural_links, """
        SELECT least(a.address, b.address) AS src, greatest(a.address, b.address) AS dst, count(*) AS n, count(*) >= $twin_events AS linked FROM {actions} a JOIN {actions} b
        ON a.coin = b.coin AND a.address <> b.address AND a.side <> b.side AND b.ms - a.ms BETWEEN 0 AND $twin_seconds * 1000 AND b.notional_u BETWEEN (1 - $twin_notional) * a.notional_u AND (1 + $twin_notional) * a.notional_u
        GROUP BY least(a.address, b.address), greatest(a.address, b.address)"""),
    "d_b4_copier": (d_b4_copier, """
        SELECT q.address, q.leader, q.n, round(q.n / o.opens, 6) AS share, CASE WHEN q.n / o.opens >= $copier_share AND o.opens >= $copier_opens THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT *, row_number() OVER (PARTITION BY address ORDER BY n DESC, leader) AS k FROM (
            SELECT b.address, a.address AS leader, count(DISTINCT b.id) AS n FROM {actions} a JOIN {actions} b ON a.coin = b.coin AND a.side = b.side AND a.address <> b.address AND b.ms - a.ms BETWEEN $copier_low_s * 1000 AND $copier_high_s * 1000
            GROUP BY b.address, a.address) g) q JOIN (SELECT address, count(*) AS opens FROM {actions} GROUP BY address) o ON q.address = o.address WHERE k = 1"""),
    "flock": (flock, """
        SELECT * FROM (SELECT a.coin, a.side, a.ms, count(DISTINCT b.address) AS addresses FROM (SELECT DISTINCT coin, side, ms FROM {actions}) a JOIN {actions} b ON a.coin = b.coin AND a.side = b.side AND a.ms - b.ms BETWEEN 0 AND $flock_s * 1000 GROUP BY a.coin, a.side, a.ms) f WHERE addresses >= 2"""),
    "exit_lag": (exit_lag, """
        SELECT c.address, c.coin, c.trip, min(m.day - c.day) AS lag FROM (SELECT *, row_number() OVER (PARTITION BY address, coin, trip ORDER BY day, ok, ln, sk, pk) AS k FROM {trip_legs} WHERE NOT opens) c
        JOIN {marks} m ON c.coin = m.coin AND m.day > c.day AND m.low_u * 100 <= c.px_u * 99 WHERE c.k = 1 GROUP BY c.address, c.coin, c.trip"""),
    "clusters": (clusters, """
        SELECT root AS cluster_id, count(*) AS members, max(node) AS last_member FROM (SELECT node, min(other) AS root FROM (
          WITH RECURSIVE near AS (SELECT src AS a, dst AS b FROM {link_edges} UNION SELECT dst, src FROM {link_edges}), reach(node, other) AS (SELECT a, a FROM near UNION SELECT r.node, b.b FROM reach r JOIN near b ON r.other = b.a)
          SELECT node, other FROM reach) x GROUP BY node) y GROUP BY root"""),
}

QUERIES = {
    "d_m2": RESCUE % "deposit",
    "d_m5": RESCUE % "internalTransfer",
    "rescues": "SELECT address, id, day, kind, usdc_u / 1e6 AS usdc, round(upnl_share, 6) AS upnl_share, round(distance, 6) AS distance FROM {rescues}",
    "hard_links": "SELECT src, dst, edge_type, weight FROM {link_edges}",
    "cluster_book": """
        SELECT r.cluster, f.coin, count(*) AS n_fills, SUMI(f.dq) AS net_position, SUMI(f.pnl_u - f.fee_u) / 1e6 AS net FROM {fills} f JOIN {registry} r ON f.address = r.address GROUP BY r.cluster, f.coin""",
    "d_h1_hedge": """
        SELECT cluster, round(1 - sum(abs_net * span) / nullif(sum(gross * span), 0), 6) AS hedge_ratio, CASE WHEN 1 - sum(abs_net * span) / nullif(sum(gross * span), 0) > $hedge_ratio THEN 'VETO' ELSE 'PASS' END AS severity FROM (
          SELECT cluster, coin, day, abs(long_q - short_q) AS abs_net, long_q + short_q AS gross, lead(day) OVER (PARTITION BY cluster, coin ORDER BY day) - day AS span FROM {cluster_steps}) s WHERE span IS NOT NULL GROUP BY cluster""",
    "d_h2": """
        SELECT a.address, a.coin AS coin_a, b.coin AS coin_b, count(*) AS days, round(CORR(a.pnl_u / 1e6, b.pnl_u / 1e6), 4) AS rho FROM {coin_days} a JOIN {coin_days} b ON a.address = b.address AND a.day = b.day AND a.coin < b.coin
        GROUP BY a.address, a.coin, b.coin HAVING count(*) >= 3 AND var_pop(a.pnl_u / 1e6) > 0 AND var_pop(b.pnl_u / 1e6) > 0""",
    # a book whose legs cancel: little net against gross exposure, and returns that do not follow the market
    "d_h2_style": """
        SELECT x.address, round(x.ratio, 6) AS net_to_gross, round(b.beta, 6) AS beta, CASE WHEN x.ratio < $net_to_gross AND abs(b.beta) < $flat_beta THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM (SELECT address, WIDESUM(net_u) / nullif(WIDESUM(gross_u), 0) AS ratio FROM (SELECT address, day, abs(SUMI(CASE WHEN szi > 0 THEN exposure_u ELSE -exposure_u END)) AS net_u, SUMI(exposure_u) AS gross_u FROM {states} WHERE szi <> 0 GROUP BY address, day) d GROUP BY address) x
        LEFT JOIN (SELECT r.address, regr_slope(r.r, m.r) AS beta FROM {returns} r JOIN {market} m ON r.day = m.day WHERE r.r IS NOT NULL GROUP BY r.address HAVING count(*) > 2 AND var_pop(m.r) > 0) b ON x.address = b.address""",
    # wallets of one funder that start together and end apart: the winner is a survivor unless all of them together gain
    "d_h4": """
        SELECT address, burst, round(own_u / 1e6, 6) AS net, round(together_u / 1e6, 6) AS together, CASE WHEN burst >= $sybil_wallets AND worst_u < 0 AND own_u = best_u AND own_u > 0 AND together_u <= 0 THEN 'VETO' ELSE 'PASS' END AS severity FROM (
          SELECT address, own_u, count(*) OVER near AS burst, max(own_u) OVER near AS best_u, min(own_u) OVER near AS worst_u, CAST(sum(own_u) OVER near AS BIGINT) AS together_u FROM (
            SELECT r.funder, f.address, min(f.day) AS first_day, SUMI(f.pnl_u - f.fee_u) AS own_u FROM {fills} f JOIN {registry} r ON f.address = r.address GROUP BY r.funder, f.address) w
          WINDOW near AS (PARTITION BY funder ORDER BY first_day RANGE BETWEEN $sybil_days PRECEDING AND $sybil_days FOLLOWING)) b""",
    # carry: against the side that pays funding (with a rising market longs do), of steady size, with a result made of funding
    "d_h6_carry": """
        SELECT s.address, round(s.against, 6) AS against_share, round(s.cv, 6) AS size_cv, CASE WHEN s.against >= $carry_days AND s.cv < $carry_cv AND f.funding_u > $funding_share * abs(d.net_u) THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM (SELECT x.address, avg(CASE WHEN (x.szi < 0) = (m.r > 0) THEN 1.0 ELSE 0.0 END) AS against, stddev_pop(x.exposure_u / 1e6) / nullif(avg(x.exposure_u / 1e6), 0) AS cv FROM {states} x JOIN {market} m ON x.day = m.day WHERE x.szi <> 0 GROUP BY x.address) s
        JOIN {day_stats} d ON s.address = d.address JOIN (SELECT address, SUMI(CASE WHEN kind = 'internalTransfer' THEN DIV(usdc_u, 100) ELSE 0 END) AS funding_u FROM {flows} GROUP BY address) f ON s.address = f.address""",
    "d_h3_wash": """
        SELECT address, round(same_u / total_u, 6) AS same_cluster_share, CASE WHEN same_u > $wash_share * total_u THEN 'VETO' ELSE 'PASS' END AS severity FROM (
          SELECT f.address, SUMI(f.notional_u) AS total_u, SUMI(CASE WHEN a.cluster % 20 = b.cluster % 20 THEN f.notional_u ELSE 0 END) AS same_u
          FROM {fills} f JOIN {registry} a ON f.address = a.address JOIN {registry} b ON f.sk = b.address GROUP BY f.address) w""",
    "d_h4_sybil": """
        SELECT funder, max(burst) AS burst, CASE WHEN max(burst) >= $sybil_wallets THEN 'VETO' ELSE 'PASS' END AS severity FROM (
          SELECT funder, count(*) OVER (PARTITION BY funder ORDER BY first_day RANGE BETWEEN $sybil_days PRECEDING AND CURRENT ROW) AS burst FROM (
            SELECT r.funder, f.address, min(f.day) AS first_day FROM {fills} f JOIN {registry} r ON f.address = r.address GROUP BY r.funder, f.address) w) b GROUP BY funder""",
    "d_h5": """
        SELECT address, max(n) AS most, CASE WHEN max(n) >= $twin_events THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT a.address, b.address AS twin, count(*) AS n FROM {actions} a
            JOIN (SELECT address, coin, side, ms, notional_u, SEQ(DIV(ms, $twin_seconds * 1000) - 1, DIV(ms, $twin_seconds * 1000) + 1) AS slot FROM {actions}) b ON a.coin = b.coin AND DIV(a.ms, $twin_seconds * 1000) = b.slot AND abs(b.ms - a.ms) <= $twin_seconds * 1000 AND a.address <> b.address AND a.side <> b.side
            AND b.notional_u BETWEEN (1 - $twin_notional) * a.notional_u AND (1 + $twin_notional) * a.notional_u GROUP BY a.address, b.address) t GROUP BY address""",
    "d_h6": """
        SELECT s.address, round(CORR(s.szi, m.r), 4) AS rho, count(*) AS days FROM {states} s JOIN {market} m ON s.day = m.day GROUP BY s.address HAVING count(*) >= 3 AND var_pop(s.szi) > 0 AND var_pop(m.r) > 0""",
}

VIEWS = {
    # the account just before each inflow, from what has been open since the day before, at the day's marks
    "inflow_states": """
        SELECT f.address, f.id, f.day, f.kind, f.usdc_u, r.start_u + p.upnl_u AS own_u, p.upnl_u, p.exposure_u FROM {flows} f JOIN {returns} r ON f.address = r.address AND f.day = r.day JOIN (
          SELECT f.address, f.id, sum(b.q * (m.vwap_u - b.cost * 1e6)) AS upnl_u, SUMI(abs(b.q) * m.vwap_u) AS exposure_u
          FROM {flows} f JOIN {open_books} b ON f.address = b.address AND f.day > b.day AND f.day <= b.until JOIN {daily_marks} m ON b.coin = m.coin AND f.day = m.day WHERE f.kind <> 'withdraw' GROUP BY f.address, f.id) p ON f.address = p.address AND f.id = p.id
        WHERE f.kind <> 'withdraw'""",
    # distance: how far marks may move against the book before the maintenance margin, half of the smallest initial one, is reached
    "rescues": """
        SELECT s.address, s.id, s.day, s.kind, s.usdc_u, s.upnl_u / nullif(own_u, 0) AS upnl_share, s.own_u / nullif(s.exposure_u, 0) - 0.5 / $max_leverage AS distance FROM {inflow_states} s
        LEFT JOIN (SELECT DISTINCT address, day FROM (SELECT address, SEQ(day - 1, day + 1) AS day FROM {trip_legs} WHERE abs(after_q) < abs(before_q)) n) c ON s.address = c.address AND s.day = c.day
        WHERE c.address IS NULL AND s.usdc_u >= $rescue_inflow * s.own_u AND s.exposure_u > 0 AND (s.upnl_u <= $rescue_upnl * s.own_u OR s.own_u < ($rescue_distance + 0.5 / $max_leverage) * s.exposure_u)""",
    "cluster_of": """
        SELECT node AS address, min(other) AS root FROM (WITH RECURSIVE near AS (SELECT src AS a, dst AS b FROM {link_edges} UNION SELECT dst, src FROM {link_edges}), reach(node, other) AS (SELECT a, a FROM near UNION SELECT r.node, b.b FROM reach r JOIN near b ON r.other = b.a)
          SELECT node, other FROM reach) x GROUP BY node""",
    "account_states": "SELECT address, day, SUMI(exposure_u) AS exposure_u, SUMI(upnl_u) AS upnl_u FROM {states} GROUP BY address, day",
    "coin_days": "SELECT address, coin, day, SUMI(pnl_u) AS pnl_u FROM {fills} GROUP BY address, coin, day",
    "net_days": "SELECT address, coin, day, SUMI(dq) AS dq FROM {fills} GROUP BY address, coin, day",
    # hard links join subaccounts to the first address of their funder's slot; a transfer goes to the address that its order's smallest part number names, and links if it is large and urgent
    "all_transfers": """
        SELECT f.address AS src, p.pk AS dst, f.id, f.day, f.usdc_u, f.priority FROM {flows} f JOIN (SELECT l_orderkey AS id, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) p ON f.id = p.id JOIN {registry} r ON p.pk = r.address
        WHERE f.kind = 'internalTransfer' AND f.address <> p.pk""",
    "transfers": "SELECT src, dst, id, day, usdc_u FROM {all_transfers} WHERE priority = '1-URGENT' AND usdc_u >= $transfer_link * 1e6",
    "link_edges": """
        SELECT m.master AS src, r.address AS dst, 'hard' AS edge_type, 1 AS weight FROM {registry} r JOIN (SELECT cluster, min(address) AS master FROM {registry} GROUP BY cluster) m ON r.cluster = m.cluster WHERE r.address <> m.master AND r.role = 'subAccount'
        UNION ALL SELECT src, dst, 'transfer', CAST(count(*) AS INT) FROM {transfers} GROUP BY src, dst""",
    # long and short quantity of a cluster's members in a coin after each day with a change
    "cluster_steps": """
        SELECT cluster, coin, day, sum(long_d) OVER w AS long_q, sum(short_d) OVER w AS short_q FROM (
          SELECT r.cluster, p.coin, p.day, SUMI(greatest(p.pos, 0) - greatest(p.prev, 0)) AS long_d, SUMI(greatest(-p.pos, 0) - greatest(-p.prev, 0)) AS short_d
          FROM {positions} p JOIN {registry} r ON p.address = r.address GROUP BY r.cluster, p.coin, p.day) d WINDOW w AS (PARTITION BY cluster, coin ORDER BY day)""",
}
