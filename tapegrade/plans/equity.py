"""Equity, flow-adjusted returns, drawdown, risk and statistics of returns."""

QUERIES = {
    "daily_returns": "SELECT address, day, equity_u / 1e6 AS equity, flow_u / 1e6 AS flow, round(r, 9) AS r FROM {returns}",
    "twr": "SELECT address, round(twr, 6) AS twr FROM {day_stats}",
    "drawdown": "SELECT address, day, round(idx, 6) AS twr_index, round(dd, 6) AS drawdown FROM {drawdowns}",
    "rolling90": """
        SELECT address, day, round(CASE WHEN least_r <= -1 THEN -1 ELSE exp(s) - 1 END, 6) AS twr90 FROM (
          SELECT address, day, sum(ln(greatest(1 + coalesce(r, 0), 1e-300))) OVER w AS s, min(coalesce(r, 0)) OVER w AS least_r FROM {returns} WINDOW w AS (PARTITION BY address ORDER BY day RANGE BETWEEN 89 PRECEDING AND CURRENT ROW)) t""",
    "risk_metrics": """
        SELECT d.address, round(sqrt(365.0) * mean_r / nullif(sd_r, 0), 6) AS sharpe, round(sqrt(365.0) * mean_r / nullif(down_r, 0), 6) AS sortino,
          round(twr / nullif(max_dd, 0), 4) AS calmar, round(max_dd, 6) AS max_dd, round(ulcer, 6) AS ulcer FROM {day_stats} d JOIN {risk} r ON d.address = r.address""",
    "tstat": "SELECT address, n, round(mean_r / nullif(sd_r / sqrt(n), 0), 6) AS tstat FROM {day_stats} WHERE n > 1",
    "d_m1": """
        SELECT address, round(share, 6) AS flow_share, round(naive, 6) AS naive_roi, round(twr, 6) AS twr, CASE WHEN naive > 0 AND twr <= 0 THEN 'VETO' WHEN share > $flow_share THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT address, twr, last_u / nullif(first_u, 0) - 1 AS naive, CASE WHEN last_u - first_u + outflow_u > 0 THEN inflow_u / (last_u - first_u + outflow_u) END AS share FROM {day_stats}) s""",
    "reconcile": """
        SELECT d.address, round(abs(d.net_u - (d.last_u - d.first_u) + (d.inflow_u - d.outflow_u)) / d.top_u, 9) AS residual,
          CASE WHEN abs(d.net_u - (d.last_u - d.first_u) + (d.inflow_u - d.outflow_u)) < 0.02 * d.top_u THEN 'ok' ELSE 'reconcile_fail' END AS verdict FROM {day_stats} d""",
    "official_roi": """
        SELECT address, round(pnl_u / greatest(100000000.0, first_u + max_flow_u), 9) AS roi FROM (
          SELECT address, SUMI(net_u) AS pnl_u, min_by(equity_u - net_u - flow_u, day) AS first_u, max(greatest(cum_u, 0)) AS max_flow_u
          FROM (SELECT *, CAST(sum(flow_u) OVER (PARTITION BY address ORDER BY day) AS BIGINT) AS cum_u FROM {equity}) e GROUP BY address) t""",
    "alpha_beta": """
        SELECT r.address, count(*) AS n, round(regr_slope(r.r, m.r), 4) AS beta, round(regr_intercept(r.r, m.r), 6) AS alpha, round(regr_r2(r.r, m.r), 6) AS r2
        FROM {returns} r JOIN {market} m ON r.day = m.day WHERE r.r IS NOT NULL AND m.r IS NOT NULL GROUP BY r.address HAVING count(*) > 2 AND var_pop(m.r) > 0""",
    "d_c7": """
        SELECT address, n, round(t, 4) AS alpha_t, CASE WHEN coalesce(t, 0) < $tstat_min THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT address, n, a / nullif(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) * (1.0 / n + mx * mx / sxx)), 0) AS t FROM (
            SELECT r.address, count(*) AS n, regr_intercept(r.r, m.r) AS a, regr_sxx(r.r, m.r) AS sxx, regr_syy(r.r, m.r) AS syy, regr_sxy(r.r, m.r) AS sxy, avg(m.r) AS mx
            FROM {returns} r JOIN {market} m ON r.day = m.day WHERE r.r IS NOT NULL AND m.r IS NOT NULL GROUP BY r.address HAVING count(*) > 2 AND var_pop(m.r) > 0) g) t""",
    "terciles": """
        SELECT address, SUMI(CASE WHEN third = 1 THEN net_u ELSE 0 END) / 1e6 AS early, SUMI(CASE WHEN third = 2 THEN net_u ELSE 0 END) / 1e6 AS middle, SUMI(CASE WHEN third = 3 THEN net_u ELSE 0 END) / 1e6 AS recent,
          SUMI(CASE WHEN third = 1 THEN net_u ELSE 0 END) > 0 AND SUMI(CASE WHEN third = 2 THEN net_u ELSE 0 END) > 0 AND SUMI(CASE WHEN third = 3 THEN net_u ELSE 0 END) > 0 AS throughout
        FROM (SELECT address, net_u, least(3, 1 + DIV((day - first) * 3, greatest(1, last - first + 1))) AS third FROM (
          SELECT address, net_u, day, min(day) OVER (PARTITION BY address) AS first, max(day) OVER (PARTITION BY address) AS last FROM {returns}) b) t GROUP BY address""",
    "recovery": """
        SELECT address, count(*) AS episodes, max(days) AS longest, round(median(days), 6) AS median_days FROM (
          SELECT address, episode, max(day) - min(day) AS days FROM (
            SELECT address, day, dd, sum(CASE WHEN dd <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY day) AS episode FROM (SELECT address, day, round(dd, 9) AS dd FROM {drawdowns}) d) e WHERE dd > 0 GROUP BY address, episode) s GROUP BY address""",
    "momentum": """
        SELECT address, pnl_7 / 1e6 AS pnl_7d, pnl_30 / 1e6 AS pnl_30d, CASE WHEN pnl_7 < 0 AND pnl_30 > 0 THEN 'crashed' WHEN pnl_7 * 30.0 > pnl_30 * 7.0 AND pnl_7 > 0 THEN 'accelerating' WHEN pnl_7 = 0 THEN 'flat' ELSE 'cooling' END AS state FROM {board}""",
    "walk_forward": """
        SELECT address, SUMI(CASE WHEN k <= 4 THEN net_u ELSE 0 END) / 1e6 AS first4, SUMI(CASE WHEN k > 4 THEN net_u ELSE 0 END) / 1e6 AS next2, SUMI(CASE WHEN k <= 4 THEN net_u ELSE 0 END) > 0 AND SUMI(CASE WHEN k > 4 THEN net_u ELSE 0 END) > 0 AS holds
        FROM (SELECT address, net_u, dense_rank() OVER (PARTITION BY address ORDER BY month) AS k FROM {months}) m WHERE k <= 6 GROUP BY address""",
    "persistence": """
        SELECT a.month, h.horizon, count(*) AS n, SUMI(CASE WHEN a.decile = 1 THEN 1 ELSE 0 END) AS top_before, SUMI(CASE WHEN a.decile = 1 AND b.decile = 1 THEN 1 ELSE 0 END) AS stayed, round(regr_r2(b.twr, a.twr), 4) AS r2
        FROM (SELECT 1 AS horizon UNION ALL SELECT 3 UNION ALL SELECT 6) h CROSS JOIN {deciles} a JOIN {deciles} b ON a.address = b.address AND b.month = a.month + h.horizon GROUP BY a.month, h.horizon HAVING count(*) > 2""",
    "pnl_crosscheck": """
        SELECT w.address, w.day, w.net_u / 1e6 AS warehouse, round(o.net + 1e-7, 3) AS own, CASE WHEN abs(w.net_u / 1e6 - o.net) <= $check_diff * greatest(1, abs(w.net_u / 1e6)) THEN 'ok' ELSE 'off' END AS verdict
        FROM (SELECT address, day, SUMI(pnl_u) - SUMI(fee_u) AS net_u FROM {fills} GROUP BY address, day) w JOIN {own_books} o ON w.address = o.address AND w.day = o.day""",
    "size_in_drawdown": """
        SELECT f.address, round(avg(CASE WHEN d.dd > 0.01 THEN f.notional_u END) / nullif(avg(CASE WHEN d.dd <= 0.01 THEN f.notional_u END), 0), 6) AS size_ratio FROM {fills} f JOIN (SELECT address, day, round(dd, 6) AS dd FROM {drawdowns}) d ON f.address = d.address AND f.day = d.day GROUP BY f.address""",
    "regimes": """
        SELECT r.address, SUMI(CASE WHEN g.regime = 'up' THEN r.net_u ELSE 0 END) / 1e6 AS up, SUMI(CASE WHEN g.regime = 'down' THEN r.net_u ELSE 0 END) / 1e6 AS down, SUMI(CASE WHEN g.regime = 'chop' THEN r.net_u ELSE 0 END) / 1e6 AS chop
        FROM {returns} r JOIN (SELECT day, CASE WHEN round(m30, 6) > 0.05 THEN 'up' WHEN round(m30, 6) < -0.05 THEN 'down' ELSE 'chop' END AS regime FROM (
          SELECT day, sum(r) OVER (ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS m30 FROM {market}) w) g ON r.day = g.day GROUP BY r.address""",
}

VIEWS = {
    # the market: daily change of one coin's mark; one row a day
    "market": """
        SELECT day, vwap_u / before_u - 1 AS r FROM (
          SELECT day, vwap_u, lag(vwap_u) OVER (ORDER BY day) AS before_u FROM {marks} WHERE coin = (SELECT min(coin) FROM {marks})) m WHERE before_u IS NOT NULL""",
    # results by the book's own accounting: what a reducing leg gains over the average cost of what was open, less fees
    "own_books": """
        SELECT l.address, l.day, sum(CASE WHEN l.opens THEN 0.0 ELSE -l.q * (l.px_u / 1e6 - c.before_cost) END - l.fee_u / 1e6) AS net FROM {trip_legs} l JOIN (
          SELECT address, coin, trip, ok, ln, sk, pk, leg, lag(cost) OVER (PARTITION BY address, coin, trip ORDER BY day, ok, ln, sk, pk, leg) AS before_cost FROM {costs}) c
        ON l.address = c.address AND l.coin = c.coin AND l.trip = c.trip AND l.ok = c.ok AND l.ln = c.ln AND l.sk = c.sk AND l.pk = c.pk AND l.leg = c.leg GROUP BY l.address, l.day""",
    "deciles": "SELECT address, month, twr, ntile(10) OVER (PARTITION BY month ORDER BY round(twr, 9) DESC, address) AS decile FROM {months}",
}
