"""Screens, vetting rules, gates, grades, score and stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrade.plans.dialect import Frames

#: The gates, in their order.
GATES = ("g1", "g1b", "g2", "g3", "g4", "g5", "g6", "g7", "g8", "g9", "g10", "g11", "g12")

QUERIES = {
    "screen_s1": """
        SELECT address, CASE WHEN vlm_all = 0 THEN 'no_volume' WHEN role = 'vault' THEN 'vault' WHEN value_u < 0 THEN 'negative' WHEN active_days < 10 THEN 'few_days' ELSE 'keep' END AS verdict FROM {board}""",
    "screen_s2": """
        SELECT b.address, CASE WHEN b.last - b.first_day < $min_history THEN 'young' WHEN d.inflow_u > 10.0 * abs(d.net_u) THEN 'flows' WHEN b.role IN ('agent', 'vault') THEN b.role ELSE 'light_ok' END AS verdict
        FROM {board} b JOIN {day_stats} d ON b.address = d.address""",
    "screen_b": """
        SELECT address, CASE WHEN vlm_30 = 0 AND vlm_7 = 0 THEN 'no_recent_volume' WHEN value_u < $screen_equity * 1e6 THEN 'small' WHEN pnl_all <= 0 OR net_all <= 0 THEN 'losing'
          WHEN vlm_all < $screen_volume_all * 1e6 THEN 'low_volume' WHEN vlm_30 < $screen_volume_30d * 1e6 THEN 'low_month_volume' ELSE 'keep' END AS reason, pnl_30 > 0 AND pnl_all > 0 AS keep_hint FROM {board}""",
    "screen_copy_sleeve": """
        SELECT b.address, coalesce(s.win_rate >= 0.5, true) AND b.pnl_all >= 20000000000 AND b.value_u >= 20000000000 AND coalesce(s.n_trips >= 10, true) AND coalesce(s.median_hold * 24 >= 1, true)
          AND coalesce(r.max_dd <= 0.5, true) AND coalesce(t.n <= $sleeve_trips, true) AND coalesce(x.mean_lev <= $leverage_veto, true) AND coalesce(u.p95 <= $sleeve_margin, true) AND b.vlm_30 > 0 AND b.last_fill - b.first_day >= $active_days AS passes
        FROM {board} b LEFT JOIN {trip_stats} s ON b.address = s.address LEFT JOIN {risk} r ON b.address = r.address LEFT JOIN {mean_leverage} x ON b.address = x.address LEFT JOIN {margin_use} u ON b.address = u.address
          LEFT JOIN (SELECT c.address, count(*) AS n FROM {closed_trips} c JOIN {last_day} d ON c.close_day > d.last - 30 GROUP BY c.address) t ON b.address = t.address""",
    "screen_b2": """
        SELECT b.address, CASE WHEN pnl_30 > 0 AND net_30 <= 0 THEN 'DROP' WHEN n_fills / active_days >= 817 OR n.need > $sleeve THEN 'FLAG' ELSE 'KEEP' END AS verdict, n_fills / active_days >= 817 AS flag_pace, coalesce(n.need > $sleeve, false) AS flag_capital
        FROM {board} b LEFT JOIN {copy_needs} n ON b.address = n.address""",
    # the first rule that decides, and all rules that speak, in their order
    "vet_d": """
        SELECT address, CASE WHEN role = 'agent' OR backstop THEN 'EXCLUDE' WHEN role = 'vault' OR hft OR churn OR one_hit OR carry THEN 'VETO' WHEN liquidated OR members >= 3 OR calibration THEN 'FLAG' ELSE 'PASS' END AS verdict, trading_u / 1e6 AS trading_equity,
          concat_ws(',', CASE WHEN role = 'agent' THEN 'EXCLUDE:agent' END, CASE WHEN backstop THEN 'EXCLUDE:backstop' END, CASE WHEN role = 'vault' THEN 'VETO:vault' END, CASE WHEN hft THEN 'VETO:hft' END, CASE WHEN churn THEN 'VETO:churn' END, CASE WHEN one_hit THEN 'VETO:one_hit' END,
            CASE WHEN carry THEN 'VETO:carry' END, CASE WHEN liquidated THEN 'FLAG:liquidated' END, CASE WHEN members >= 3 THEN 'FLAG:cluster' END, CASE WHEN calibration THEN 'FLAG:calibration' END, CASE WHEN debt_u > 0 THEN 'SUBTRACT:debt' END) AS reasons
        FROM (SELECT b.address, b.role, g.name = 'backstop' AS backstop, coalesce(s.median_hold * 86400 < $avg_hold_s, false) AS hft, f.n_fills > $churn * coalesce(s.n_trips, 0) AS churn, coalesce(c.top_coin > 0.8 AND s.n_trips < 15, false) AS one_hit,
            coalesce(abs(w.funding_u) >= abs(s.net_u) AND abs(f.bias) < $two_sided, false) AS carry, l.lifetime >= 1 AS liquidated, coalesce(m.members, 1) AS members, g.slot = 0 AS calibration, coalesce(w.debt_u, 0) AS debt_u, d.last_u - coalesce(w.debt_u, 0) AS trading_u
          FROM {board} b JOIN {registry} g ON b.address = g.address JOIN {day_stats} d ON b.address = d.address JOIN {liquidations} l ON b.address = l.address JOIN (SELECT cluster, count(*) AS members FROM {registry} GROUP BY cluster) m ON g.cluster = m.cluster
          JOIN (SELECT address, count(*) AS n_fills, SUMI(CASE WHEN dq > 0 THEN notional_u ELSE -notional_u END) / SUMI(notional_u) AS bias FROM {fills} GROUP BY address) f ON b.address = f.address
          LEFT JOIN {trip_stats} s ON b.address = s.address LEFT JOIN {coin_share} c ON b.address = c.address
          LEFT JOIN (SELECT address, SUMI(CASE WHEN kind = 'internalTransfer' THEN DIV(usdc_u, 100) ELSE 0 END) AS funding_u, SUMI(CASE WHEN kind = 'internalTransfer' AND priority = '2-HIGH' THEN usdc_u ELSE 0 END) AS debt_u FROM {flows} GROUP BY address) w ON b.address = w.address) v""",
    "m_score": """
        SELECT address, least(100, score) AS score, score >= $promote AND verdict <> 'VETO' AND verdict <> 'EXCLUDE' AS promoted FROM (
          SELECT b.address, v.verdict, CASE WHEN b.pnl_30 > 0 AND b.pnl_all > 0 THEN 25 ELSE 0 END + CASE WHEN b.vlm_30 >= 100000000000 THEN 15 ELSE 0 END + 15 * greatest(0, least(1, round(1 - r.ulcer, 6))) + CASE WHEN r.max_dd <= 0.5 THEN 15 ELSE 0 END
            + CASE WHEN x.mean_lev BETWEEN 2 AND $leverage_max THEN 10 ELSE 0 END + CASE WHEN s.median_hold * 24 >= 1 THEN 10 ELSE 0 END + CASE WHEN coalesce(c.top_coin, 0) <= 0.8 THEN 10 ELSE 0 END AS score
          FROM {board} b JOIN {risk} r ON b.address = r.address JOIN (<vet>) v ON b.address = v.address LEFT JOIN {trip_stats} s ON b.address = s.address LEFT JOIN {coin_share} c ON b.address = c.address LEFT JOIN {mean_leverage} x ON b.address = x.address) p""",
    "screen_named": """
        SELECT screen, address FROM (
          SELECT p.screen, m.address, bool_and(CASE WHEN p.op = 'ge' THEN m.v >= p.bound ELSE m.v <= p.bound END) AS ok, count(m.v) AS met FROM {metric_rows} m JOIN {screen_rules} p ON m.metric = p.metric GROUP BY p.screen, m.address) s JOIN (SELECT screen AS name, count(*) AS rules FROM {screen_rules} GROUP BY screen) n ON s.screen = n.name WHERE ok AND met = rules""",
    "d_c1": "SELECT address, pnl_30 / 1e6 AS board_30d, net_30 / 1e6 AS account_30d, CASE WHEN pnl_30 > 0 AND net_30 <= 0 THEN 'VETO' ELSE 'PASS' END AS severity FROM {board}",
    "d_c6": "SELECT address, median_u / 1e6 AS median_equity, round((last_u - first_u) / greatest(first_u, 1000000000.0), 6) AS roi, CASE WHEN median_u < $equity_floor * 1e6 THEN 'VETO' ELSE 'PASS' END AS severity FROM {day_stats}",
    "d_b3": "SELECT address, role, CASE WHEN role = 'vault' THEN 'VETO' ELSE 'PASS' END AS severity FROM {registry}",
    "d_b5": "SELECT r.address, CASE WHEN k.address IS NULL THEN 'PASS' ELSE 'VETO' END AS severity FROM {registry} r LEFT JOIN (SELECT address FROM {registry} WHERE address % 97 = 0) k ON r.address = k.address",
    "d_b2": """
        SELECT address, round(p, 6) AS p_algo, CASE WHEN p >= 0.7 THEN 'ADT' WHEN p <= 0.3 THEN 'MDT' ELSE 'UNSURE' END AS category FROM (
          SELECT a.address, (least(1, hours / 24.0) + least(1, n / 200.0) + same_clip) / 3 AS p FROM (
            SELECT address, count(DISTINCT hour(ts)) AS hours, count(*) AS n, 1 - count(DISTINCT notional_u) / count(*) AS same_clip FROM {actions} GROUP BY address) a) q""",
    "d_r4": "SELECT address, lifetime, recent, CASE WHEN recent > $liq_recent OR lifetime > $liq_lifetime THEN 'VETO' ELSE 'PASS' END AS severity FROM {liquidations}",
    "d_m8": """
        SELECT b.address, round(i.income_u / nullif(abs(b.pnl_all), 0), 6) AS income_share, CASE WHEN i.income_u > $income_share * abs(b.pnl_all) THEN 'INFO' ELSE 'PASS' END AS severity
        FROM {board} b JOIN (SELECT address, SUMI(CASE WHEN priority = '1-URGENT' THEN DIV(usdc_u, 100) ELSE 0 END) AS income_u FROM {flows} GROUP BY address) i ON b.address = i.address""",
    "d_m6": """
        SELECT d.address, w.debt_u / 1e6 AS borrowed, CASE WHEN w.debt_u > 0 AND d.top_u / greatest(1.0, d.last_u - w.debt_u) > $leverage_max THEN 'VETO' WHEN w.debt_u > 0 THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM {day_stats} d JOIN (SELECT address, SUMI(CASE WHEN kind = 'internalTransfer' AND priority = '2-HIGH' THEN usdc_u ELSE 0 END) AS debt_u FROM {flows} GROUP BY address) w ON d.address = w.address""",
    "d_r5": """
        SELECT address, round(p99, 6) AS p99, CASE WHEN p99 > $leverage_veto THEN 'VETO' WHEN p99 > $leverage_spike * $leverage_max THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT address, coalesce(min(CASE WHEN upto >= 0.99 * total THEN lev END), max(lev)) AS p99 FROM {leverage_weights} GROUP BY address) l""",
    "leverage_tw": """
        SELECT address, round(sum(lev * span) / nullif(sum(span), 0), 6) AS mean_leverage, round(max(lev), 6) AS max_leverage, round(min(CASE WHEN upto >= 0.95 * total THEN lev END), 6) AS p95, round(min(CASE WHEN upto >= 0.99 * total THEN lev END), 6) AS p99 FROM {leverage_weights} WHERE span IS NOT NULL GROUP BY address""",
    "d_m4": """
        SELECT address, SUMI(CASE WHEN lev < before AND dd > 0.01 THEN 1 ELSE 0 END) AS lowered, CASE WHEN SUMI(CASE WHEN lev < before AND dd > 0.01 THEN 1 ELSE 0 END) > 0 THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT l.address, round(l.lev, 6) AS lev, lag(round(l.lev, 6)) OVER (PARTITION BY l.address ORDER BY l.day) AS before, round(d.dd, 6) AS dd FROM {leverage} l JOIN {drawdowns} d ON l.address = d.address AND l.day = d.day) s GROUP BY address""",
    "d_m3": """
        SELECT address, SUMI(CASE WHEN margin_u > before_u AND szi = before_szi AND upnl_u < 0 THEN 1 ELSE 0 END) AS topups, CASE WHEN SUMI(CASE WHEN margin_u > before_u AND szi = before_szi AND upnl_u < 0 THEN 1 ELSE 0 END) >= 2 THEN 'VETO'
          WHEN SUMI(CASE WHEN margin_u > before_u AND szi = before_szi AND upnl_u < 0 THEN 1 ELSE 0 END) = 1 THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT *, lag(margin_u) OVER w AS before_u, lag(szi) OVER w AS before_szi FROM {states} WINDOW w AS (PARTITION BY address, coin ORDER BY day)) s GROUP BY address""",
    "gates": f"SELECT address, {', '.join(GATES)}, {' AND '.join(GATES)} AS passed FROM {{gate_rows}}",
    "funnel": f"SELECT reason, count(*) AS n FROM (SELECT address, CASE {' '.join(f"WHEN NOT {g} THEN '{g.replace('g', 'G')}'" for g in ('g12', *GATES[:-1]))} ELSE 'passed' END AS reason FROM {{gate_rows}}) r GROUP BY reason",
    "sensitivity": """
        SELECT f.factor, SUMI(CASE WHEN r.max_dd <= $max_dd * f.factor THEN 1 ELSE 0 END) AS drawdown_ok, SUMI(CASE WHEN r.ulcer <= 0.05 * f.factor THEN 1 ELSE 0 END) AS ulcer_ok
        FROM {risk} r CROSS JOIN (SELECT 0.9 AS factor UNION ALL SELECT 1.0 UNION ALL SELECT 1.1) f GROUP BY f.factor""",
    "composite_score": "SELECT address, category, round(score, 6) AS score FROM {scored}",
    "ranking": "SELECT address, category, round(score, 6) AS score, tenure, row_number() OVER (PARTITION BY category ORDER BY round(score, 6) DESC, tenure DESC, address) AS place FROM {scored}",
    # reasons to vet an address again that the last days gave, against what was stored before them
    "revet": "SELECT address, kind, min(day) AS first_day, count(*) AS n FROM {triggers} GROUP BY address, kind",
    # the first stage that holds an address back, or the last one it reached
    "stages": f"""
        SELECT u.address, CASE WHEN b.address IS NULL THEN 'discovered' WHEN s1.verdict <> 'keep' OR s2.verdict <> 'light_ok' THEN 'screened_out' WHEN b.n_fills >= $history_cap THEN 'light_ok' WHEN q.verdict = 'reconcile_fail' THEN 'reconcile_fail'
            WHEN p.vetoed THEN 'vet_fail' WHEN g.genuine_late THEN 'reformed' WHEN p.families >= $qa_families THEN 'needs_qa' WHEN NOT ({' AND '.join('g.' + x for x in GATES)}) THEN 'deep_ok'
            WHEN w.breached THEN 'dropped' WHEN w.days >= $forward_days AND w.acts > 0 THEN 'forward_validated' WHEN w.acts > 0 THEN 'watch' ELSE 'qualified' END AS stage
        FROM {{registry}} u LEFT JOIN {{board}} b ON u.address = b.address LEFT JOIN (<s1>) s1 ON u.address = s1.address LEFT JOIN (<s2>) s2 ON u.address = s2.address LEFT JOIN {{reconciled}} q ON u.address = q.address
        LEFT JOIN {{verdicts}} p ON u.address = p.address LEFT JOIN {{gate_rows}} g ON u.address = g.address LEFT JOIN {{forward}} w ON u.address = w.address""",
}
QUERIES["m_score"] = QUERIES["m_score"].replace("<vet>", QUERIES["vet_d"])
QUERIES["stages"] = QUERIES["stages"].replace("<s1>", QUERIES["screen_s1"]).replace("<s2>", QUERIES["screen_s2"])

VIEWS = {
    "coin_share": "SELECT address, max(net_u) / nullif(sum(abs(net_u)), 0) AS top_coin FROM (SELECT address, coin, SUMI(net_u) AS net_u FROM {closed_trips} GROUP BY address, coin) c GROUP BY address",
    "liquidations": "SELECT f.address, SUMI(CASE WHEN flag = 'R' AND ln = 1 AND ok % 40 = 0 THEN 1 ELSE 0 END) AS lifetime, SUMI(CASE WHEN flag = 'R' AND ln = 1 AND ok % 40 = 0 AND f.day > d.last - 180 THEN 1 ELSE 0 END) AS recent FROM {fills} f CROSS JOIN {last_day} d GROUP BY f.address",
    # gross notional at the day's marks over equity, and how long it stood
    "states": """
        SELECT p.address, p.coin, p.day, p.pos AS szi, abs(p.pos) * m.vwap_u AS exposure_u, DIV(abs(p.pos) * m.vwap_u, 5 + p.sk % 5) AS margin_u, p.pos * (m.vwap_u - p.px_u) AS upnl_u
        FROM (SELECT address, coin, day, max_by(pos, k) AS pos, max_by(px_u, k) AS px_u, max_by(sk, k) AS sk FROM (
          SELECT *, row_number() OVER (PARTITION BY address, coin, day ORDER BY ok, ln, sk, pk) AS k FROM {positions}) q GROUP BY address, coin, day) p JOIN {marks} m ON p.coin = m.coin AND p.day = m.day""",
    "leverage": """
        SELECT s.address, s.day, s.exposure_u / e.equity_u AS lev, lead(s.day) OVER (PARTITION BY s.address ORDER BY s.day) - s.day AS span
        FROM (SELECT address, day, SUMI(exposure_u) AS exposure_u FROM {states} GROUP BY address, day) s JOIN {equity} e ON s.address = e.address AND s.day = e.day""",
    "leverage_weights": "SELECT *, sum(span) OVER (PARTITION BY address ORDER BY lev, day) AS upto, sum(span) OVER (PARTITION BY address) AS total FROM {leverage}",
    "mean_leverage": "SELECT address, sum(lev * span) / nullif(sum(span), 0) AS mean_lev FROM {leverage} WHERE span IS NOT NULL GROUP BY address",
    "margin_use": "SELECT s.address, PCTL(s.margin_u / e.equity_u, 0.95) AS p95 FROM (SELECT address, day, SUMI(margin_u) AS margin_u FROM {states} GROUP BY address, day) s JOIN {equity} e ON s.address = e.address AND s.day = e.day GROUP BY s.address",
    # the last 180 days and the last six calendar months of each address
    "lately": f"""
        SELECT b.address, coalesce(h.net_u, 0) AS net_u, coalesce(h.grew, false) AS grew, coalesce(m.active, 0) AS active, coalesce(m.positive, 0) AS positive, m.best_u, m.sum_u, g.longest, b.last - b.last_fill AS quiet
        FROM {{board}} b LEFT JOIN (SELECT r.address, SUMI(r.net_u) AS net_u, CASE WHEN min(1 + coalesce(r.r, 0)) <= 0 THEN false ELSE sum(ln(greatest(1 + coalesce(r.r, 0), 1e-300))) > 0 END AS grew FROM {{returns}} r CROSS JOIN {{last_day}} d WHERE r.day > d.last - 180 GROUP BY r.address) h ON b.address = h.address
        LEFT JOIN (SELECT address, count(*) AS active, SUMI(CASE WHEN net_u > 0 THEN 1 ELSE 0 END) AS positive, max(net_u) AS best_u, SUMI(net_u) AS sum_u FROM {{months}} m CROSS JOIN {{last_day}} d WHERE m.month > d.last_month - 6 AND m.month <= d.last_month GROUP BY address) m ON b.address = m.address
        LEFT JOIN (SELECT g.address, max(g.gap) AS longest FROM {{day_gaps}} g CROSS JOIN {{last_day}} d WHERE g.day > d.last - 180 GROUP BY g.address) g ON b.address = g.address""",
    "best_trades": """
        SELECT address, SUMI(net_u) AS net_u, SUMI(CASE WHEN k <= 5 AND net_u > 0 THEN net_u ELSE 0 END) AS top5_u FROM (
          SELECT address, net_u, row_number() OVER (PARTITION BY address ORDER BY net_u DESC, coin, trip) AS k FROM {closed_trips}) r GROUP BY address""",
    "reconciled": """
        SELECT address, CASE WHEN abs(net_u - (last_u - first_u) + (inflow_u - outflow_u)) < 0.02 * top_u THEN 'ok' ELSE 'reconcile_fail' END AS verdict FROM {day_stats}""",
    # the last days of an address against its own envelope before them: drawdown, leverage, fills a day
    "forward": """
        SELECT address, acts, days, coalesce(dd > 1.5 * dd_before, false) OR coalesce(lev > 1.5 * lev_before, false) OR coalesce(pace > 2 * pace_before, false) AS breached FROM (
          SELECT f.address, SUMI(CASE WHEN f.day > d.last - $forward_days THEN 1 ELSE 0 END) AS acts, max(d.last) - min(f.day) AS days,
            max(CASE WHEN f.day > d.last - $forward_days THEN x.dd END) AS dd, max(CASE WHEN f.day <= d.last - $forward_days THEN x.dd END) AS dd_before,
            max(CASE WHEN f.day > d.last - $forward_days THEN l.lev END) AS lev, max(CASE WHEN f.day <= d.last - $forward_days THEN l.lev END) AS lev_before,
            max(CASE WHEN f.day > d.last - $forward_days THEN f.n END) AS pace, max(CASE WHEN f.day <= d.last - $forward_days THEN f.n END) AS pace_before
          FROM (SELECT address, day, count(*) AS n FROM {fills} GROUP BY address, day) f CROSS JOIN {last_day} d LEFT JOIN {drawdowns} x ON f.address = x.address AND f.day = x.day LEFT JOIN {leverage} l ON f.address = l.address AND f.day = l.day GROUP BY f.address) w""",
    # what an address had shown until the watched days: worst drawdown, median hold
    "envelopes": """
        SELECT r.address, r.dd, h.hold FROM (SELECT x.address, max(x.dd) AS dd FROM {drawdowns} x CROSS JOIN {last_day} d WHERE x.day <= d.last - $watch_days GROUP BY x.address) r
        LEFT JOIN (SELECT t.address, median(t.hold) AS hold FROM {closed_trips} t CROSS JOIN {last_day} d WHERE t.close_day <= d.last - $watch_days GROUP BY t.address) h ON r.address = h.address""",
    "triggers": """
        SELECT f.address, 'liquidation' AS kind, f.day FROM {fills} f CROSS JOIN {last_day} d WHERE f.day > d.last - $watch_days AND f.flag = 'R' AND f.ln = 1 AND f.ok % 40 = 0
        UNION ALL SELECT r.address, 'rescue', r.day FROM {rescues} r CROSS JOIN {last_day} d WHERE r.day > d.last - $watch_days
        UNION ALL SELECT x.address, 'drawdown', x.day FROM {drawdowns} x JOIN {envelopes} e ON x.address = e.address CROSS JOIN {last_day} d WHERE x.day > d.last - $watch_days AND round(x.dd, 9) > round($envelope * e.dd, 9)
        UNION ALL SELECT l.address, 'leverage', l.day FROM {leverage} l CROSS JOIN {last_day} d WHERE l.day > d.last - $watch_days AND l.lev > $leverage_max
        UNION ALL SELECT p.src, 'link', p.day FROM (SELECT src, dst, min(day) AS day FROM {transfers} GROUP BY src, dst) p CROSS JOIN {last_day} d WHERE p.day > d.last - $watch_days
        UNION ALL SELECT w.address, 'crashed', w.day FROM (
          SELECT address, day, sum(net_u) OVER (PARTITION BY address ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS week_u, sum(net_u) OVER (PARTITION BY address ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS month_u
          FROM (SELECT e.address, e.day, e.net_u FROM {equity} e CROSS JOIN {last_day} d WHERE e.day > d.last - $watch_days - 30) r) w CROSS JOIN {last_day} d WHERE w.day > d.last - $watch_days AND w.week_u < 0 AND w.month_u > 0
        UNION ALL SELECT h.address, 'hold_drift', h.day FROM (SELECT t.address, max(t.close_day) AS day, median(t.hold) AS hold FROM {closed_trips} t CROSS JOIN {last_day} d WHERE t.close_day > d.last - $watch_days GROUP BY t.address) h JOIN {envelopes} e ON h.address = e.address
          WHERE (h.hold * 86400 > $hold_high_s AND e.hold * 86400 <= $hold_high_s) OR (h.hold * 86400 < $hold_low_s AND e.hold * 86400 >= $hold_low_s)""",
    "gate_rows": """
        SELECT b.address, b.last - b.first_day >= $min_history AND y.active >= $months_required AS g1,
          coalesce(c.genuine / nullif(c.active, 0) >= $coverage_min AND c.first_genuine <= $late_start_months, false) AND NOT v.vetoed AS g1b, coalesce(c.first_genuine > $late_start_months, false) AS genuine_late,
          w.coverage >= $weeks_min AND y.quiet <= $longest_gap AND coalesce(y.longest <= $longest_gap, false) AS g2, coalesce(s.day_share >= $day_close_share AND s.median_hold * 86400 BETWEEN $hold_low_s AND $hold_high_s, false) AS g3,
          coalesce(s.avg_hold * 86400 >= $avg_hold_s, false) AND f.maker < $maker_max AND b.n_fills / b.active_days < $trades_per_day AND coalesce(o.requests, 0) <= $requests_per_fill * b.n_fills AS g4, d.twr > 0 AND d.net_u > 0 AND y.grew AND y.net_u > 0 AND z.r5 AS g5,
          y.positive >= 4 AND z.r6 AND coalesce(y.sum_u > 0 AND y.best_u <= $month_share * y.sum_u, false) AND coalesce(t.net_u > 0 AND t.top5_u < $top5_share * t.net_u, false) AS g6, r.max_dd <= $max_dd AND z.r7 AS g7,
          coalesce(x.mean_lev <= $leverage_max AND u.p95 <= $margin_p95, false) AND z.r8 AS g8, l.recent <= $liq_recent AND l.lifetime <= $liq_lifetime AND z.r9 AS g9, NOT v.vetoed AS g10,
          coalesce(d.mean_r / nullif(d.sd_r / sqrt(d.n), 0) >= $tstat_min, false) AND coalesce(q.dsr >= $dsr_min, false) AND z.r11 AS g11, d.median_u >= $equity_floor * 1e6 AS g12
        FROM {board} b JOIN {day_stats} d ON b.address = d.address JOIN {risk} r ON b.address = r.address JOIN {coverage} c ON b.address = c.address JOIN {liquidations} l ON b.address = l.address
        JOIN {lately} y ON b.address = y.address JOIN {vetoed} v ON b.address = v.address JOIN {rolling_gates} z ON b.address = z.address LEFT JOIN (SELECT address, count(*) AS requests FROM {flows} GROUP BY address) o ON b.address = o.address LEFT JOIN {best_trades} t ON b.address = t.address LEFT JOIN {margin_use} u ON b.address = u.address LEFT JOIN {dsr_rows} q ON b.address = q.address
        LEFT JOIN {mean_leverage} x ON b.address = x.address
        LEFT JOIN {trip_stats} s ON b.address = s.address JOIN (SELECT address, avg(CASE WHEN crossed THEN 0.0 ELSE 1.0 END) AS maker FROM {fills} GROUP BY address) f ON b.address = f.address
        JOIN (SELECT k.address, SUMI(CASE WHEN k.days >= $week_days THEN 1 ELSE 0 END) / max(n.weeks) AS coverage FROM {weeks} k JOIN (SELECT address, max(week) - min(week) + 1 AS weeks FROM {weeks} GROUP BY address) n ON k.address = n.address GROUP BY k.address) w ON b.address = w.address""",
    "scored": """
        SELECT address, category, tenure, 20 * p_tenure + 20 * p_edge + 20 * p_consistency + 15 * p_discipline + 10 * p_efficiency + 8 * p_regularity + 7 * p_alpha - penalty AS score FROM (
          SELECT address, category, tenure, penalty, percent_rank() OVER (PARTITION BY category ORDER BY tenure) AS p_tenure, percent_rank() OVER (PARTITION BY category ORDER BY edge) AS p_edge,
            percent_rank() OVER (PARTITION BY category ORDER BY consistency) AS p_consistency, percent_rank() OVER (PARTITION BY category ORDER BY -dd) AS p_discipline, percent_rank() OVER (PARTITION BY category ORDER BY efficiency) AS p_efficiency,
            percent_rank() OVER (PARTITION BY category ORDER BY regularity) AS p_regularity, percent_rank() OVER (PARTITION BY category ORDER BY alpha) AS p_alpha
          FROM (SELECT g.address, CASE WHEN g.role = 'user' THEN 'MDT' ELSE 'ADT' END AS category, c.genuine AS tenure, round(coalesce(d.mean_r / nullif(d.sd_r, 0), 0), 6) AS edge, round(c.positive, 6) AS consistency, round(r.max_dd, 6) AS dd,
              round(coalesce(s.won_u / nullif(s.lost_u, 0), 0), 6) AS efficiency, b.active_days AS regularity, round(d.twr, 6) AS alpha, v.penalty
            FROM {registry} g JOIN {verdicts} v ON g.address = v.address JOIN {board} b ON g.address = b.address JOIN {coverage} c ON g.address = c.address JOIN {day_stats} d ON g.address = d.address JOIN {risk} r ON g.address = r.address LEFT JOIN {trip_stats} s ON g.address = s.address) m) p""",
    "metric_rows": """
        SELECT address, 'account_value' AS metric, value_u / 1e6 AS v FROM {board} UNION ALL SELECT address, 'pnl_all', pnl_all / 1e6 FROM {board} UNION ALL SELECT address, 'volume_all', vlm_all / 1e6 FROM {board} UNION ALL
        SELECT address, 'volume_30d', vlm_30 / 1e6 FROM {board} UNION ALL SELECT address, 'win_rate', win_rate FROM {trip_stats} UNION ALL SELECT address, 'trades', CAST(n_trips AS DOUBLE) FROM {trip_stats} UNION ALL
        SELECT address, 'hold_h', median_hold * 24.0 FROM {trip_stats} UNION ALL SELECT address, 'max_dd', round(max_dd, 9) FROM {risk} UNION ALL SELECT address, 'span', CAST(last_fill - first_day AS DOUBLE) FROM {board}""",
    "screen_rules": """
        SELECT 'part_1' AS screen, 'win_rate' AS metric, 'ge' AS op, 0.5 AS bound UNION ALL SELECT 'part_1', 'pnl_all', 'ge', 20000 UNION ALL SELECT 'part_1', 'account_value', 'ge', 5000 UNION ALL SELECT 'part_1', 'trades', 'ge', 10 UNION ALL SELECT 'part_1', 'hold_h', 'ge', 1 UNION ALL
        SELECT 'part_2', 'max_dd', 'le', 0.5 UNION ALL SELECT 'part_2', 'span', 'ge', 60 UNION ALL SELECT 'part_2', 'volume_30d', 'ge', 1 UNION ALL SELECT 'thirty_days', 'win_rate', 'ge', 0.7 UNION ALL SELECT 'thirty_days', 'trades', 'ge', 5 UNION ALL SELECT 'thirty_days', 'trades', 'le', 100 UNION ALL
        SELECT 'all_time', 'volume_all', 'ge', 1000000 UNION ALL SELECT 'all_time', 'pnl_all', 'ge', 0 UNION ALL SELECT 'all_time', 'volume_30d', 'ge', 10000 UNION ALL SELECT 'drawdown', 'max_dd', 'le', 0.22 UNION ALL SELECT 'recent', 'volume_30d', 'ge', 1 UNION ALL SELECT 'recent', 'pnl_all', 'ge', 0""",
}

#: A view or a query in parentheses that is joined to the board by address, with its name.
_SIDE = re.compile(r"(LEFT )?JOIN (\{\w+\}|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)) (\w+) ON b\.address = \3\.address")
#: What the gates read of an address, written by a query of its own each.
GATE_PARTS = ("rolling_gates", "risk", "coverage", "liquidations", "lately", "vetoed", "best_trades", "margin_use", "dsr_rows", "mean_leverage")


def gate_rows(t: Frames) -> DataFrame:
    """The text's joins by address as one grouping of stacked rows.

    As joins they are one stage, in which a task holds the sorts and groups of all sides at once: more than its memory, however few rows there are.
    Every side has one row an address but the verdicts, which have as many as the registry and stay a join.
    """
    t.keep(tuple(name for name in GATE_PARTS if name not in t.made))
    columns, joins = VIEWS["gate_rows"].split("FROM {board} b ")
    sides = [("b", "{board}", ""), *[(name, source, left) for left, source, name in _SIDE.findall(joins) if name != "v"]]
    rows = None
    for name, source, _ in sides:
        side = t.sql(f"SELECT * FROM {source} x WHERE address IS NOT NULL")
        side = side.select("address", F.struct(*side.columns).alias(name))
        rows = side if rows is None else rows.unionByName(side, allowMissingColumns=True)
    t.made["gate_sides"] = rows.groupBy("address").agg(*[F.first(name, ignorenulls=True).alias(name) for name, _, _ in sides])
    whole = " AND ".join(f"{name} IS NOT NULL" for name, _, left in sides if not left)
    return t.written(f"{columns} FROM {{gate_sides}} JOIN {{vetoed}} v ON b.address = v.address WHERE {whole}", "gate_rows")


#: Views with a plan of their own.
BUILT = {"gate_rows": gate_rows}
