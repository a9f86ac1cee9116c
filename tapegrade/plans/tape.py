"""Tape, ledger, universe, coverage audits and sources."""

QUERIES = {
    "tape_scan": "SELECT coin, count(*) AS n, SUMI(notional_u) / 1e6 AS notional, SUMI(CASE WHEN side = 'B' THEN 1 ELSE 0 END) AS buys, min(day) AS first_day, max(day) AS last_day FROM {tape} GROUP BY coin",
    "dedupe_tid": "SELECT ok, ln, sk, pk, count(*) AS copies, min(px_u) / 1e6 AS px FROM (SELECT ok, ln, sk, pk, px_u FROM {tape} UNION ALL SELECT ok, ln, sk, pk, px_u FROM {tape} WHERE ok % 10 = 0) t GROUP BY ok, ln, sk, pk",
    "addr_day_stats": """
        SELECT d.address, d.day, d.trades, d.notional_u / 1e6 AS notional, d.buys, d.coins, round(d.maker, 6) AS maker_share_proxy, p.top3
        FROM (SELECT address, day, count(*) AS trades, SUMI(notional_u) AS notional_u, SUMI(buy) AS buys, count(DISTINCT coin) AS coins, avg(maker) AS maker FROM {sides} GROUP BY address, day) d
        JOIN (SELECT address, day, JOINED(CAST(cp AS STRING)) AS top3 FROM (
          SELECT address, day, cp, row_number() OVER (PARTITION BY address, day ORDER BY notional_u DESC, cp) AS k FROM (SELECT address, day, cp, SUMI(notional_u) AS notional_u FROM {sides} GROUP BY address, day, cp) c) r WHERE k <= 3 GROUP BY address, day) p
        ON d.address = p.address AND d.day = p.day""",
    "active_addresses": "SELECT day, count(DISTINCT address) AS addresses FROM {sides} GROUP BY day",
    "coin_dex": """
        SELECT CASE WHEN instr(coin, ':') > 0 THEN split_part(coin, ':', 1) ELSE '' END AS dex, CASE WHEN instr(coin, ':') > 0 THEN split_part(coin, ':', 2) ELSE coin END AS symbol, count(*) AS n
        FROM (SELECT CASE WHEN sk % 5 = 0 THEN 'xyz:' || coin ELSE coin END AS coin FROM {tape}) t
        GROUP BY CASE WHEN instr(coin, ':') > 0 THEN split_part(coin, ':', 1) ELSE '' END, CASE WHEN instr(coin, ':') > 0 THEN split_part(coin, ':', 2) ELSE coin END""",
    "dex_share": "SELECT dex, oi_u / 1e6 AS oi, round(oi_u / CAST(sum(oi_u) OVER () AS BIGINT), 6) AS share FROM (SELECT CASE WHEN sk % 5 = 0 THEN 'xyz' ELSE 'main' END AS dex, SUMI(notional_u) AS oi_u FROM {tape} GROUP BY CASE WHEN sk % 5 = 0 THEN 'xyz' ELSE 'main' END) t",
    "history_truncated": "SELECT address, count(*) AS n_fills, count(*) >= $stored_fills AS history_truncated FROM {fills} GROUP BY address",
    "funding_scan": "SELECT address, month, count(*) AS payments, SUMI(usdc_u) / 1e6 AS usdc FROM {flows} WHERE kind = 'internalTransfer' GROUP BY address, month",
    "ledger_flows": "SELECT address, kind, count(*) AS n, SUMI(flow_u) / 1e6 AS net_flow, SUMI(usdc_u) / 1e6 AS gross FROM {flows} GROUP BY address, kind",
    "order_spam": "SELECT f.address, round(o.requests / f.n, 6) AS requests_per_fill FROM (SELECT address, count(*) AS requests FROM {flows} GROUP BY address) o JOIN (SELECT address, count(*) AS n FROM {fills} GROUP BY address) f ON o.address = f.address",
    "weight_budget": "SELECT address, SUMI(20 + DIV(n + 19, 20)) AS weight, SUMI(20 + DIV(n + 19, 20)) <= $weight_per_minute AS within FROM (SELECT address, month, count(*) AS n FROM {fills} GROUP BY address, month) m GROUP BY address",
    "gap_audit": """
        SELECT coin, count(*) AS gaps, max(gap) AS longest, SUMI(gap - 1) AS days_missing FROM (
          SELECT coin, day - lag(day) OVER (PARTITION BY coin ORDER BY day) AS gap FROM (SELECT DISTINCT coin, day FROM {tape}) d) g WHERE gap > 1 GROUP BY coin""",
    "fills_union_schemas": """
        SELECT shape, count(*) AS n, SUMI(fee_u) / 1e6 AS fees, SUMI(CASE WHEN fee_u IS NULL THEN 1 ELSE 0 END) AS without_fee FROM (
          SELECT 'node_trades' AS shape, address, notional_u, CAST(NULL AS BIGINT) AS fee_u FROM {fills} WHERE day < 9000 UNION ALL
          SELECT 'node_fills', address, notional_u, fee_u FROM {fills} WHERE day >= 9000 AND day < 9800 UNION ALL
          SELECT 'node_fills_by_block', address, notional_u, fee_u FROM {fills} WHERE day >= 9800) u GROUP BY shape""",
    "extract_identifiers": """
        SELECT kind, lower(name) AS name, SUMI(CASE WHEN source = 'pages' THEN 1 ELSE 0 END) AS in_pages, SUMI(CASE WHEN source = 'documents' THEN 1 ELSE 0 END) AS in_documents FROM (
          SELECT source, 'host' AS kind, FOUND(body, '://([a-zA-Z0-9.:-]+)') AS name FROM {texts} UNION ALL SELECT source, 'address', FOUND(body, '(0x<digits>)') FROM {texts}) t GROUP BY kind, lower(name)""",
    "gaps": "SELECT address, max(gap) AS longest_gap, SUMI(CASE WHEN gap > $longest_gap THEN 1 ELSE 0 END) AS long_gaps, round(median(gap), 6) AS median_gap FROM {day_gaps} GROUP BY address",
    "weekly_coverage": """
        SELECT w.address, count(*) AS weeks, round(avg(CASE WHEN coalesce(k.days, 0) >= $week_days THEN 1.0 ELSE 0.0 END), 6) AS coverage
        FROM (SELECT address, SEQ(first_week, last_week) AS week FROM (SELECT address, min(week) AS first_week, max(week) AS last_week FROM {weeks} GROUP BY address) b) w
        LEFT JOIN {weeks} k ON w.address = k.address AND w.week = k.week GROUP BY w.address""",
    "month_spine": "SELECT address, month, days, net_u / 1e6 AS net, grade FROM {graded}",
    # months whose tape lacks days are unknown, not inactive; months before the archive are graded from coarser data
    "month_grades": "SELECT address, month, grade, coarse FROM {known_grades}",
    "known_coverage": """
        SELECT address, SUMI(CASE WHEN grade <> 'inactive' THEN 1 ELSE 0 END) AS active, SUMI(CASE WHEN grade = 'unknown' THEN 1 ELSE 0 END) AS unknown, SUMI(CASE WHEN grade = 'genuine' AND coarse THEN 1 ELSE 0 END) AS coarse_genuine,
          round(SUMI(CASE WHEN grade = 'genuine' THEN 1 ELSE 0 END) / nullif(CAST(SUMI(CASE WHEN grade IN ('genuine', 'violation') THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS coverage FROM {known_grades} GROUP BY address""",
    "genuine_coverage": "SELECT address, months, active, genuine, first_genuine, round(genuine / nullif(active, 0), 6) AS coverage FROM {coverage}",
    "genuine_runs": """
        SELECT address, min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM (
          SELECT address, month, month - row_number() OVER (PARTITION BY address ORDER BY month) AS island FROM {graded} WHERE grade = 'genuine') r GROUP BY address, island""",
    "universe": """
        SELECT address, JOINED(source) AS sources FROM (
          SELECT address, 'board' AS source FROM {registry} UNION SELECT address, 'tape' FROM {sides} UNION SELECT address, 'seed' FROM {registry} WHERE slot = 0) u GROUP BY address""",
    "leaderboard_unpivot": """
        SELECT address, span, CASE span WHEN 'day' THEN pnl_1 WHEN 'week' THEN pnl_7 WHEN 'month' THEN pnl_30 ELSE pnl_all END / 1e6 AS pnl,
          CASE span WHEN 'day' THEN 0 WHEN 'week' THEN vlm_7 WHEN 'month' THEN vlm_30 ELSE vlm_all END / 1e6 AS vlm
        FROM {board} CROSS JOIN (SELECT 'day' AS span UNION ALL SELECT 'week' UNION ALL SELECT 'month' UNION ALL SELECT 'allTime') s""",
    "leaderboard_diff": """
        SELECT coalesce(a.address, b.address) AS address, CASE WHEN a.address IS NULL THEN 'added' WHEN b.address IS NULL THEN 'removed' WHEN a.pnl_u <> b.pnl_u THEN 'changed' ELSE 'same' END AS change
        FROM (SELECT address, SUMI(pnl_u) AS pnl_u FROM {fills} f CROSS JOIN {last_day} d WHERE f.day BETWEEN d.last - 764 AND d.last - 400 GROUP BY address) a
        FULL OUTER JOIN (SELECT address, SUMI(pnl_u) AS pnl_u FROM {fills} f CROSS JOIN {last_day} d WHERE f.day BETWEEN d.last - 564 AND d.last - 200 GROUP BY address) b ON a.address = b.address""",
    "changed_addresses": """
        SELECT b.address, b.pnl_u / 1e6 AS pnl FROM (SELECT address, SUMI(pnl_u) AS pnl_u FROM {fills} GROUP BY address) b
        ANTI JOIN (SELECT address, SUMI(pnl_u) AS pnl_u FROM {fills} f CROSS JOIN {last_day} d WHERE f.day <= d.last - 30 GROUP BY address) a ON a.address = b.address AND a.pnl_u = b.pnl_u""",
    "semi_candidates": "SELECT f.address, count(*) AS n FROM {fills} f SEMI JOIN (SELECT address FROM {board} WHERE pnl_all > 0) c ON f.address = c.address GROUP BY f.address",
    "anti_ignore": "SELECT f.address, count(*) AS n FROM {fills} f ANTI JOIN (SELECT address FROM {registry} WHERE role IN ('vault', 'agent')) i ON f.address = i.address GROUP BY f.address",
    "resolve_master": """
        SELECT coalesce(m.master, f.address) AS owner, count(*) AS n, SUMI(f.notional_u) / 1e6 AS notional FROM {fills} f LEFT JOIN (
          SELECT r.address, c.master FROM {registry} r JOIN (SELECT cluster, min(address) AS master FROM {registry} WHERE role <> 'agent' GROUP BY cluster) c ON r.cluster = c.cluster WHERE r.role = 'agent') m ON f.address = m.address
        GROUP BY coalesce(m.master, f.address)""",
    "liq_join": """
        SELECT coalesce(f.address, l.address) AS address, coalesce(f.month, l.month) AS month, coalesce(f.n, 0) AS in_fills, coalesce(l.n, 0) AS in_ledger, greatest(coalesce(f.n, 0), coalesce(l.n, 0)) AS liquidations
        FROM (SELECT address, month, count(*) AS n FROM {fills} WHERE flag = 'R' AND ln = 1 GROUP BY address, month) f
        FULL OUTER JOIN (SELECT address, month, count(*) AS n FROM {flows} WHERE kind = 'withdraw' AND id % 13 = 0 GROUP BY address, month) l ON f.address = l.address AND f.month = l.month""",
    "session_entropy": """
        SELECT address, count(*) AS hours, round(-sum(p * ln(p)), 6) AS entropy FROM (
          SELECT address, h, count(*) / CAST(sum(count(*)) OVER (PARTITION BY address) AS BIGINT) AS p FROM (SELECT address, hour(ts) AS h FROM {actions}) a GROUP BY address, h) q GROUP BY address""",
    "watch_top10": "SELECT address, net_all / 1e6 AS net FROM {board} ORDER BY net_all DESC, address LIMIT 10",
    "window_wins": "SELECT address, CASE WHEN pnl_1 > 0 THEN 1 ELSE 0 END + CASE WHEN pnl_7 > 0 THEN 1 ELSE 0 END + CASE WHEN pnl_30 > 0 THEN 1 ELSE 0 END + CASE WHEN pnl_all > 0 THEN 1 ELSE 0 END AS wins FROM {board}",
}
QUERIES["extract_identifiers"] = QUERIES["extract_identifiers"].replace("<digits>", "[a-fA-F0-9]" * 40)

VIEWS = {
    "texts": "SELECT 'pages' AS source, url AS body FROM {pages} UNION ALL SELECT 'documents', text FROM {documents}",
    "known_grades": """
        SELECT g.address, g.month, CASE WHEN coalesce(t.days, 0) < DAYNUM(MONTHDATE(g.month + 1)) - DAYNUM(MONTHDATE(g.month)) - $missing_days THEN 'unknown' ELSE g.grade END AS grade, g.month <= d.last_month - $archive_months AS coarse
        FROM {graded} g LEFT JOIN (SELECT month, count(DISTINCT day) AS days FROM {fills} GROUP BY month) t ON g.month = t.month CROSS JOIN {last_day} d""",
    "sides": """
        SELECT CASE WHEN k = 0 THEN buyer ELSE seller END AS address, day, coin, notional_u, 1 - k AS buy, CASE WHEN k = 0 THEN seller ELSE buyer END AS cp, CASE WHEN (side = 'B') = (k = 0) THEN 0 ELSE 1 END AS maker
        FROM (SELECT buyer, seller, day, coin, notional_u, side, SEQ(0, 1) AS k FROM {tape}) t""",
}

#: name -> (DataFrame plan, oracle text). First and last price by the order of fills are partial aggregates: a hot coin's day is neither sorted nor in one task.
PLANS = {
    "candles_from_tape": (lambda t: t.sql("""
        SELECT coin, day, min_by(px_u, struct(ok, ln, sk, pk)) / 1e6 AS o, max(px_u) / 1e6 AS h, min(px_u) / 1e6 AS l, max_by(px_u, struct(ok, ln, sk, pk)) / 1e6 AS c, SUMI(sz) AS v FROM {tape} GROUP BY coin, day"""), """
        SELECT coin, day, min_by(px_u, o) / 1e6 AS o, max(px_u) / 1e6 AS h, min(px_u) / 1e6 AS l, max_by(px_u, o) / 1e6 AS c, SUMI(sz) AS v FROM (
          SELECT coin, day, px_u, sz, row_number() OVER (PARTITION BY coin, day ORDER BY ok, ln, sk, pk) AS o FROM {tape}) t GROUP BY coin, day"""),
}
