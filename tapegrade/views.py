"""The domain's tables as views over the star schema: fills, tape, ledger flows, equity, registry, marks, actions.

A customer is an address, a part type is a coin, a line is a fill (bought if its status is open), an order
is a ledger entry, an event is a live action. Amounts are millionths of a dollar.
"""

VIEWS = {
    # one row a fill; (day, ok, ln, sk, pk) is its total order
    "fills": """
        SELECT o.o_custkey AS address, p.p_type AS coin, DAYNUM(l.l_shipdate) AS day, MONTHNUM(l.l_shipdate) AS month,
          l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_suppkey AS sk, l.l_partkey AS pk,
          CAST(l.l_quantity AS BIGINT) AS sz,
          CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_quantity AS BIGINT) ELSE -CAST(l.l_quantity AS BIGINT) END AS dq,
          CAST(round(l.l_extendedprice * 100) AS BIGINT) * 10000 AS notional_u,
          DIV(CAST(round(l.l_extendedprice * 100) AS BIGINT) * 10000, CAST(l.l_quantity AS BIGINT)) AS px_u,
          CAST(round(l.l_extendedprice * 100) AS BIGINT) * CAST(round(l.l_tax * 100) AS BIGINT) AS fee_u,
          CAST(round(l.l_extendedprice * 100) AS BIGINT) * (CAST(round(l.l_discount * 100) AS BIGINT) - 5) * 100 AS pnl_u,
          l.l_returnflag <> 'N' AS crossed, l.l_returnflag AS flag
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "tape": """
        SELECT day, month, coin, ok, ln, sk, pk, px_u, sz, notional_u, CASE WHEN dq > 0 THEN 'B' ELSE 'A' END AS side, crossed,
          CASE WHEN dq > 0 THEN address ELSE 1000000000 + sk END AS buyer, CASE WHEN dq > 0 THEN 1000000000 + sk ELSE address END AS seller FROM {fills}""",
    "flows": """
        SELECT o_custkey AS address, o_orderkey AS id, DAYNUM(o_orderdate) AS day, MONTHNUM(o_orderdate) AS month,
          CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdraw' ELSE 'internalTransfer' END AS kind,
          CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS usdc_u,
          CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS flow_u,
          o_orderpriority AS priority FROM {orders}""",
    "registry": """
        SELECT c_custkey AS address, c_name AS name, c_nationkey AS funder, c_custkey % 50 AS slot, CAST(round(c_acctbal * 100) AS BIGINT) * 10000 AS value_u,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 'vault' WHEN 'FURNITURE' THEN 'agent' WHEN 'HOUSEHOLD' THEN 'subAccount' ELSE 'user' END AS role,
          c_nationkey * 50 + c_custkey % 50 AS cluster FROM {customer}""",
    # one row an address and active day
    "equity": """
        SELECT x.address, x.day, MONTHNUM(DAYDATE(x.day)) AS month, x.net_u, x.flow_u,
          CAST(1000000000000 + r.value_u + sum(x.net_u + x.flow_u) OVER (PARTITION BY x.address ORDER BY x.day) AS BIGINT) AS equity_u
        FROM (SELECT address, day, SUMI(net_u) AS net_u, SUMI(flow_u) AS flow_u FROM (
            SELECT address, day, pnl_u - fee_u AS net_u, CAST(0 AS BIGINT) AS flow_u FROM {fills} UNION ALL
            SELECT address, day, CAST(0 AS BIGINT), flow_u FROM {flows}) GROUP BY address, day) x
        JOIN {registry} r ON x.address = r.address""",
    # Modified Dietz with flows at half a day
    "returns": """
        SELECT address, day, month, equity_u, flow_u, net_u, start_u,
          CASE WHEN start_u + 0.5 * flow_u > 0 THEN (equity_u - start_u - flow_u) / (start_u + 0.5 * flow_u) END AS r
        FROM (SELECT *, equity_u - net_u - flow_u AS start_u FROM {equity}) e""",
    "twr_curve": """
        SELECT address, day, month, equity_u, flow_u, net_u, r,
          CASE WHEN min(1 + coalesce(r, 0)) OVER (PARTITION BY address ORDER BY day) <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 + coalesce(r, 0), 1e-300))) OVER (PARTITION BY address ORDER BY day)) END AS idx FROM {returns}""",
    "drawdowns": """
        SELECT *, 1 - idx / greatest(1.0, peak) AS dd FROM (
          SELECT *, max(idx) OVER (PARTITION BY address ORDER BY day) AS peak FROM {twr_curve}) c""",
    "positions": """
        SELECT *, pos - dq AS prev FROM (
          SELECT *, CAST(sum(dq) OVER (PARTITION BY address, coin ORDER BY day, ok, ln, sk, pk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos FROM {fills}) f""",
    # a fill that crosses zero is two legs: one closes, one opens; the fee follows the size, the pnl the closing leg
    "legs": """
        SELECT address, coin, day, month, ok, ln, sk, pk, leg, px_u, crossed,
          CASE WHEN leg = 1 THEN pos WHEN flips THEN -prev ELSE dq END AS q,
          CASE WHEN leg = 1 THEN 0 ELSE prev END AS before_q, CASE WHEN leg = 0 AND flips THEN 0 ELSE pos END AS after_q,
          CASE WHEN leg = 1 THEN DIV(fee_u * abs(pos), sz) WHEN flips THEN fee_u - DIV(fee_u * abs(pos), sz) ELSE fee_u END AS fee_u,
          CASE WHEN leg = 1 THEN 0 ELSE pnl_u END AS pnl_u
        FROM (SELECT *, SEQ(0, CASE WHEN flips THEN 1 ELSE 0 END) AS leg FROM (SELECT *, (prev > 0 AND pos < 0) OR (prev < 0 AND pos > 0) AS flips FROM {positions}) a) b""",
    "trip_legs": """
        SELECT *, CAST(sum(CASE WHEN before_q = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY address, coin ORDER BY day, ok, ln, sk, pk, leg ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip,
          before_q = 0 OR (before_q > 0) = (q > 0) AS opens FROM {legs}""",
    "trips": """
        SELECT address, coin, trip, min(day) AS open_day, max(day) AS close_day, max(month) AS month, CASE WHEN max(after_q) > 0 THEN 'long' ELSE 'short' END AS side,
          max(abs(after_q)) AS max_size, SUMI(CASE WHEN opens AND before_q <> 0 THEN 1 ELSE 0 END) AS adds, SUMI(CASE WHEN opens THEN 0 ELSE 1 END) AS reduces,
          SUMI(CASE WHEN opens THEN px_u * abs(q) ELSE 0 END) AS in_u, SUMI(CASE WHEN opens THEN abs(q) ELSE 0 END) AS in_q,
          SUMI(CASE WHEN opens THEN 0 ELSE px_u * abs(q) END) AS out_u, SUMI(CASE WHEN opens THEN 0 ELSE abs(q) END) AS out_q,
          SUMI(pnl_u) AS pnl_u, SUMI(fee_u) AS fee_u, SUMI(px_u * abs(q)) AS traded_u, bool_or(after_q = 0) AS closed, max(CASE WHEN before_q = 0 THEN abs(q) END) AS first_clip
        FROM {trip_legs} GROUP BY address, coin, trip""",
    # average cost of what is open after each leg
    "costs": """
        SELECT address, coin, trip, day, ok, ln, sk, pk, leg, after_q, CASE WHEN after_q <> 0 THEN mult * part / abs(after_q) END AS cost FROM (
          SELECT *, sum(CASE WHEN opens THEN px_u / 1e6 * abs(q) / mult ELSE 0 END) OVER (PARTITION BY address, coin, trip ORDER BY day, ok, ln, sk, pk, leg ROWS UNBOUNDED PRECEDING) AS part FROM (
            SELECT *, exp(sum(CASE WHEN opens OR after_q = 0 THEN 0 ELSE ln(abs(after_q) / abs(before_q)) END) OVER (PARTITION BY address, coin, trip ORDER BY day, ok, ln, sk, pk, leg ROWS UNBOUNDED PRECEDING)) AS mult
            FROM {trip_legs}) m) s""",
    # what is open from the end of a day with fills until the next such day, or the end of the data
    "open_books": """
        SELECT s.address, s.coin, s.trip, s.day, s.q, round(s.cost, 6) AS cost, coalesce(s.until, d.last + 1) AS until FROM (
          SELECT address, coin, trip, day, after_q AS q, cost, lead(day) OVER (PARTITION BY address, coin ORDER BY day) AS until FROM (
            SELECT *, row_number() OVER (PARTITION BY address, coin, day ORDER BY ok DESC, ln DESC, sk DESC, pk DESC, leg DESC) AS back FROM {costs}) c WHERE back = 1) s CROSS JOIN {last_day} d WHERE s.q <> 0""",
    # a coin's last mark on every day, numbered
    "daily_marks": """
        SELECT coin, SEQ(day, until - 1) AS day, vwap_u FROM (SELECT m.coin, m.day, m.vwap_u, coalesce(lead(m.day) OVER (PARTITION BY m.coin ORDER BY m.day), d.last + 1) AS until FROM {marks} m CROSS JOIN {last_day} d) x""",
    # equity from each active day until the next one
    "equity_spans": "SELECT address, day, equity_u, coalesce(lead(day) OVER (PARTITION BY address ORDER BY day), 10000000) AS until FROM {equity}",
    # days on which an open position's loss is at least so much of the equity: every open position is marked every day
    "underwater_days": """
        SELECT b.address, b.coin, b.trip, m.day, abs(b.q) * m.vwap_u / e.equity_u AS share FROM {open_books} b JOIN {daily_marks} m ON b.coin = m.coin AND m.day >= b.day AND m.day < b.until
        JOIN {equity_spans} e ON b.address = e.address AND m.day >= e.day AND m.day < e.until WHERE e.equity_u > 0 AND b.q * (m.vwap_u - b.cost * 1e6) <= $zombie_upnl * e.equity_u""",
    # runs of such days that last
    "zombies": """
        SELECT address, coin, trip, min(day) AS first, max(day) AS last, max(round(share, 6)) AS share FROM (
          SELECT *, day - row_number() OVER (PARTITION BY address, coin, trip ORDER BY day) AS island FROM {underwater_days}) u GROUP BY address, coin, trip, island HAVING max(day) - min(day) > $zombie_days""",
    "closed_trips": "SELECT *, pnl_u - fee_u AS net_u, close_day - open_day AS hold FROM {trips} WHERE closed",
    "marks": """
        SELECT coin, day, max(px_u) AS high_u, min(px_u) AS low_u, DIV(SUMI(notional_u), SUMI(sz)) AS vwap_u, SUMI(notional_u) AS volume_u FROM {fills} GROUP BY coin, day""",
    "actions": """
        SELECT event_id AS id, user_id AS address, MS(ts) AS ms, ts, event_type AS coin, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS side,
          CAST(round(value * 1000000) AS BIGINT) AS notional_u FROM {events}""",
    # windows of the official board, counted back from the last day of the data
    "last_day": "SELECT max(day) AS last, max(month) AS last_month FROM {fills}",
    "board": """
        SELECT f.address, max(r.value_u) AS value_u, max(r.role) AS role, SUMI(pnl_u) AS pnl_all, SUMI(notional_u) AS vlm_all,
          SUMI(CASE WHEN f.day > d.last - 30 THEN pnl_u ELSE 0 END) AS pnl_30, SUMI(CASE WHEN f.day > d.last - 30 THEN notional_u ELSE 0 END) AS vlm_30,
          SUMI(CASE WHEN f.day > d.last - 7 THEN pnl_u ELSE 0 END) AS pnl_7, SUMI(CASE WHEN f.day > d.last - 7 THEN notional_u ELSE 0 END) AS vlm_7,
          SUMI(CASE WHEN f.day > d.last - 1 THEN pnl_u ELSE 0 END) AS pnl_1,
          SUMI(pnl_u - fee_u) AS net_all, SUMI(CASE WHEN f.day > d.last - 30 THEN pnl_u - fee_u ELSE 0 END) AS net_30,
          SUMI(f.n) AS n_fills, count(*) AS active_days, min(f.day) AS first_day, max(f.day) AS last_fill, max(d.last) AS last
        FROM (SELECT address, day, SUMI(pnl_u) AS pnl_u, SUMI(fee_u) AS fee_u, SUMI(notional_u) AS notional_u, count(*) AS n FROM {fills} GROUP BY address, day) f JOIN {registry} r ON f.address = r.address CROSS JOIN {last_day} d GROUP BY f.address""",
    "trip_stats": """
        SELECT address, count(*) AS n_trips, SUMI(net_u) AS net_u, avg(CASE WHEN net_u > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
          SUMI(CASE WHEN net_u > 0 THEN net_u ELSE 0 END) AS won_u, SUMI(CASE WHEN net_u < 0 THEN -net_u ELSE 0 END) AS lost_u,
          avg(CASE WHEN net_u > 0 THEN net_u END) AS avg_win, avg(CASE WHEN net_u < 0 THEN -net_u END) AS avg_loss,
          median(CASE WHEN net_u > 0 THEN net_u END) AS median_win, median(CASE WHEN net_u < 0 THEN -net_u END) AS median_loss, max(-net_u) AS max_loss,
          median(hold) AS median_hold, avg(hold) AS avg_hold, PCTL(hold, 0.25) AS q1_hold, PCTL(hold, 0.75) AS q3_hold,
          avg(CASE WHEN hold < 1 THEN 1.0 ELSE 0.0 END) AS day_share, avg(CASE WHEN hold >= 1 THEN 1.0 ELSE 0.0 END) AS overnight,
          median(CASE WHEN net_u > 0 THEN hold END) AS win_hold, median(CASE WHEN net_u < 0 THEN hold END) AS loss_hold, SUMI(traded_u) AS traded_u,
          stddev_samp(max_size) / nullif(avg(max_size), 0) AS size_cv
        FROM {closed_trips} GROUP BY address""",
    "day_stats": """
        SELECT address, count(r) AS n, avg(r) AS mean_r, stddev_samp(r) AS sd_r, sqrt(avg(least(r, 0) * least(r, 0))) AS down_r,
          avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4, CASE WHEN min(1 + coalesce(r, 0)) <= 0 THEN -1 ELSE exp(sum(ln(greatest(1 + coalesce(r, 0), 1e-300)))) - 1 END AS twr,
          SUMI(net_u) AS net_u, SUMI(CASE WHEN flow_u > 0 THEN flow_u ELSE 0 END) AS inflow_u, SUMI(CASE WHEN flow_u < 0 THEN -flow_u ELSE 0 END) AS outflow_u,
          min_by(equity_u - net_u - flow_u, day) AS first_u, max_by(equity_u, day) AS last_u, max(equity_u) AS top_u, median(equity_u) AS median_u
        FROM {returns} GROUP BY address""",
    "risk": "SELECT address, max(dd) AS max_dd, sqrt(avg(dd * dd)) AS ulcer, max(idx) AS top FROM {drawdowns} GROUP BY address",
    "months": "SELECT address, month, SUMI(net_u) AS net_u, count(*) AS days, CASE WHEN min(1 + coalesce(r, 0)) <= 0 THEN -1 ELSE exp(sum(ln(greatest(1 + coalesce(r, 0), 1e-300)))) - 1 END AS twr, max(CASE WHEN r < -0.05 THEN 1 ELSE 0 END) AS bad_day FROM {returns} GROUP BY address, month",
    "weeks": "SELECT address, DIV(day + 3, 7) AS week, count(DISTINCT day) AS days FROM {fills} GROUP BY address, DIV(day + 3, 7)",
    "day_gaps": "SELECT address, day, day - lag(day) OVER (PARTITION BY address ORDER BY day) AS gap FROM (SELECT DISTINCT address, day FROM {fills}) d",
    # calendar months of each address from its first to its last, graded
    "graded": """
        SELECT s.address, s.month, coalesce(m.net_u, 0) AS net_u, coalesce(m.days, 0) AS days,
          CASE WHEN coalesce(m.days, 0) < 1 THEN 'inactive' WHEN m.bad_day = 1 OR m.twr < -$max_dd THEN 'violation' ELSE 'genuine' END AS grade
        FROM (SELECT address, SEQ(first_month, last_month) AS month FROM (SELECT address, min(month) AS first_month, max(month) AS last_month FROM {months} GROUP BY address) b) s
        LEFT JOIN {months} m ON s.address = m.address AND s.month = m.month""",
    "coverage": """
        SELECT address, count(*) AS months, SUMI(CASE WHEN grade <> 'inactive' THEN 1 ELSE 0 END) AS active, SUMI(CASE WHEN grade = 'genuine' THEN 1 ELSE 0 END) AS genuine,
          CAST(min(CASE WHEN grade = 'genuine' THEN rank_active END) AS BIGINT) AS first_genuine, avg(CASE WHEN net_u > 0 THEN 1.0 ELSE 0.0 END) AS positive
        FROM (SELECT *, sum(CASE WHEN grade <> 'inactive' THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY month) AS rank_active FROM {graded}) g GROUP BY address""",
}
