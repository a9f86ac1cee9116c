"""Positions, round trips, holding times, edge, concentration and sizing."""

QUERIES = {
    "positions": "SELECT address, coin, day, ok, ln, sk, pk, dq, prev, pos FROM {positions}",
    "continuity": """
        SELECT address, coin, count(*) AS n_fills, SUMI(CASE WHEN prev <> coalesce(before_pos, 0) THEN 1 ELSE 0 END) AS breaks
        FROM (SELECT *, lag(pos) OVER (PARTITION BY address, coin ORDER BY day, ok, ln, sk, pk) AS before_pos FROM {positions}) p GROUP BY address, coin""",
    "round_trips": """
        SELECT address, coin, trip, side, open_day, close_day, close_day - open_day AS hold, max_size, adds, reduces, DIV(in_u, in_q) / 1e6 AS vwap_in,
          DIV(out_u, out_q) / 1e6 AS vwap_out, pnl_u / 1e6 AS pnl, fee_u / 1e6 AS fees FROM {trips} WHERE closed""",
    "hold_stats": """
        SELECT address, n_trips, round(median_hold, 6) AS median_hold, round(q3_hold - q1_hold, 6) AS iqr_hold, round(day_share, 6) AS share_within_day, round(overnight, 6) AS share_overnight
        FROM {trip_stats}""",
    "style_bucket": """
        SELECT address, round(median_hold * 86400, 3) AS median_hold_s, CASE WHEN median_hold * 86400 < $avg_hold_s THEN 'hft' WHEN median_hold * 86400 < 3600 THEN 'scalp'
          WHEN median_hold * 86400 <= $hold_high_s THEN 'intraday' WHEN median_hold * 86400 < 86400 THEN 'day' ELSE 'holder' END AS style FROM {trip_stats}""",
    "edge_metrics": """
        SELECT address, n_trips, round(won_u / nullif(lost_u, 0), 6) AS profit_factor, round(avg_win / nullif(avg_loss, 0), 6) AS payoff, round(win_rate, 6) AS win_rate,
          round(net_u / 1e6 / n_trips + 1e-9, 6) AS expectancy, round(10000.0 * net_u / nullif(traded_u, 0), 6) AS expectancy_bps FROM {trip_stats}""",
    "concentration": """
        SELECT t.address, round(t.top1_u / nullif(t.net_u, 0), 6) AS top1_share, round(t.top5_u / nullif(t.net_u, 0), 6) AS top5_share,
          round(c.best_u / nullif(t.net_u, 0), 6) AS top_coin_share, round(m.best_u / nullif(m.net_u, 0), 6) AS best_month_share
        FROM (SELECT address, SUMI(net_u) AS net_u, SUMI(CASE WHEN k <= 1 AND net_u > 0 THEN net_u ELSE 0 END) AS top1_u, SUMI(CASE WHEN k <= 5 AND net_u > 0 THEN net_u ELSE 0 END) AS top5_u
              FROM (SELECT address, net_u, row_number() OVER (PARTITION BY address ORDER BY net_u DESC, coin, trip) AS k FROM {closed_trips}) r GROUP BY address) t
        JOIN (SELECT address, max(net_u) AS best_u FROM (SELECT address, coin, SUMI(net_u) AS net_u FROM {closed_trips} GROUP BY address, coin) x GROUP BY address) c ON t.address = c.address
        JOIN (SELECT address, max(net_u) AS best_u, SUMI(net_u) AS net_u FROM {months} GROUP BY address) m ON t.address = m.address""",
    "gini": """
        SELECT address, n, round(CASE WHEN n > 0 THEN weighted / (n * total) END, 6) AS gini FROM (
          SELECT address, count(*) AS n, sum(net_u / 1e6) AS total, sum((2 * k - c - 1) * (net_u / 1e6)) AS weighted FROM (
            SELECT address, net_u, row_number() OVER (PARTITION BY address ORDER BY net_u, coin, trip) AS k, count(*) OVER (PARTITION BY address) AS c FROM {closed_trips} WHERE net_u > 0) r
          GROUP BY address) g""",
    "size_cv": """
        SELECT s.address, round(s.size_cv, 6) AS size_cv, round(p.cv, 6) AS trades_per_day_cv, round(e.cv, 6) AS equity_cv FROM {trip_stats} s
        JOIN (SELECT address, stddev_samp(n) / avg(n) AS cv FROM (SELECT address, day, count(*) AS n FROM {fills} GROUP BY address, day) d GROUP BY address) p ON s.address = p.address
        JOIN (SELECT address, stddev_samp(equity_u / 1e6) / nullif(avg(equity_u / 1e6), 0) AS cv FROM {equity} GROUP BY address) e ON s.address = e.address""",
    # round trips that an order set beforehand has reduced
    "stop_usage": """
        SELECT t.address, count(*) AS n_trips, SUMI(CASE WHEN r.trip IS NULL THEN 0 ELSE 1 END) AS n_stopped, round(avg(CASE WHEN r.trip IS NULL THEN 0.0 ELSE 1.0 END), 6) AS stop_share,
          round(avg(CASE WHEN t.net_u < 0 THEN CASE WHEN r.trip IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS stop_share_of_losses
        FROM {closed_trips} t LEFT JOIN (SELECT DISTINCT l.address, l.coin, l.trip FROM {trip_legs} l SEMI JOIN {trigger_orders} o ON l.ok = o.ok WHERE NOT l.opens) r
        ON t.address = r.address AND t.coin = r.coin AND t.trip = r.trip GROUP BY t.address""",
    "avg_cost": "SELECT address, coin, trip, day, ok, ln, sk, pk, leg, round(cost + 1e-7, 3) AS avg_cost FROM {costs} WHERE after_q <> 0",
    "d_r1_martingale": """
        SELECT address, count(*) AS n_trips, SUMI(CASE WHEN share > $underwater_share AND multiple >= $size_multiple THEN 1 ELSE 0 END) AS n_martingale,
          CASE WHEN avg(CASE WHEN share > $underwater_share AND multiple >= $size_multiple THEN 1.0 ELSE 0.0 END) > $martingale_trips THEN 'VETO'
               WHEN max(CASE WHEN share > $underwater_share AND multiple >= $size_multiple THEN 1 ELSE 0 END) = 1 THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM (SELECT address, coin, trip, SUMI(CASE WHEN worse THEN px_u * abs(q) ELSE 0 END) / nullif(SUMI(CASE WHEN added THEN px_u * abs(q) ELSE 0 END), 0) AS share,
                max(abs(after_q)) / max(CASE WHEN before_q = 0 THEN abs(q) END) AS multiple
              FROM (SELECT *, opens AND before_q <> 0 AS added, opens AND before_q <> 0 AND CASE WHEN before_q > 0 THEN WIDE(px_u, had_q) < had_u ELSE WIDE(px_u, had_q) > had_u END AS worse FROM (
                SELECT *, sum(CASE WHEN opens THEN px_u * abs(q) ELSE 0 END) OVER w AS had_u, sum(CASE WHEN opens THEN abs(q) ELSE 0 END) OVER w AS had_q FROM {trip_legs}
                WINDOW w AS (PARTITION BY address, coin, trip ORDER BY day, ok, ln, sk, pk, leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h) u
              GROUP BY address, coin, trip HAVING bool_or(after_q = 0)) t GROUP BY address""",
    "d_r2": """
        SELECT b.address, round(s.loss_hold / nullif(s.win_hold, 0), 6) AS hold_ratio, coalesce(z.n, 0) AS zombies, z.longest AS zombie_days, z.share AS zombie_share,
          CASE WHEN coalesce(z.share > $zombie_equity, false) THEN 'VETO' WHEN coalesce(s.loss_hold / nullif(s.win_hold, 0) > $disposition, false) OR z.n > 0 THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM (SELECT DISTINCT address FROM {fills}) b LEFT JOIN {trip_stats} s ON b.address = s.address
        LEFT JOIN (SELECT address, count(*) AS n, max(last - first) AS longest, max(share) AS share FROM {zombies} GROUP BY address) z ON b.address = z.address""",
    "d_r3": """
        SELECT s.address, round(avg_win / nullif(avg_loss, 0), 6) AS payoff, round(skew, 6) AS skew, round(max_loss / nullif(median_win, 0), 6) AS loss_to_win, round(cvar / 1e6, 6) AS cvar,
          CASE WHEN -cvar * 0.05 > 0.5 * abs(mean) AND avg_win / nullif(avg_loss, 0) < $payoff_min AND skew < 0 THEN 'VETO' WHEN avg_win / nullif(avg_loss, 0) < $payoff_min AND skew < 0 THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM {trip_stats} s JOIN (
          SELECT address, max(mean) AS mean, avg(CASE WHEN k <= ceil(0.05 * n) THEN net_u END) AS cvar,
            avg((net_u - mean) / 1e6 * ((net_u - mean) / 1e6) * ((net_u - mean) / 1e6)) / nullif(power(avg((net_u - mean) / 1e6 * ((net_u - mean) / 1e6)), 1.5), 0) AS skew
          FROM (SELECT address, net_u, avg(net_u) OVER (PARTITION BY address) AS mean, count(*) OVER (PARTITION BY address) AS n, row_number() OVER (PARTITION BY address ORDER BY net_u, coin, trip) AS k FROM {closed_trips}) r
          GROUP BY address) m ON s.address = m.address""",
    "d_r6_tilt": """
        SELECT address, round(after_loss / nullif(after_win, 0), 6) AS tilt, CASE WHEN after_loss / nullif(after_win, 0) > $tilt_max THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM (SELECT address, avg(CASE WHEN last_u < 0 THEN max_size END) AS after_loss, avg(CASE WHEN last_u > 0 THEN max_size END) AS after_win
              FROM (SELECT address, max_size, lag(net_u) OVER (PARTITION BY address ORDER BY close_day, coin, trip) AS last_u FROM {closed_trips}) l GROUP BY address) t""",
    "d_r7": """
        SELECT address, 30 - least(30, to_end) AS days_in, SUMI(1) AS n_losses, SUMI(-net_u) / 1e6 AS losses FROM (
          SELECT address, net_u, DAYNUM(MONTHDATE(MONTHNUM(DAYDATE(close_day)) + 1)) - 1 - close_day AS to_end FROM {closed_trips} WHERE net_u < 0) t GROUP BY address, 30 - least(30, to_end)""",
    # losses realised just after a month's end, when a window has rolled
    "d_r7_edges": """
        SELECT address, count(*) AS losses, round(avg(CASE WHEN DAYNUM(MONTHDATE(MONTHNUM(DAYDATE(close_day)))) + $edge_days > close_day THEN 1.0 ELSE 0.0 END), 6) AS edge_share,
          CASE WHEN count(*) >= $edge_losses AND avg(CASE WHEN DAYNUM(MONTHDATE(MONTHNUM(DAYDATE(close_day)))) + $edge_days > close_day THEN 1.0 ELSE 0.0 END) > $edge_share THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM {closed_trips} WHERE net_u < 0 GROUP BY address""",
    "d_c2": """
        SELECT t.address, round(top1_u / nullif(t.net_u, 0), 6) AS top1_share, round(top5_u / nullif(t.net_u, 0), 6) AS top5_share, round(c.best_u / nullif(t.net_u, 0), 6) AS top_coin_share, round(m.best_u / nullif(m.net_u, 0), 6) AS best_month_share, round(t.gini, 6) AS gini,
          CASE WHEN t.net_u <= 0 OR top5_u > $top5_share * t.net_u OR m.net_u <= 0 OR m.best_u > $month_share * m.net_u THEN 'VETO' ELSE 'PASS' END AS severity
        FROM (SELECT address, SUMI(net_u) AS net_u, SUMI(CASE WHEN k = 1 AND net_u > 0 THEN net_u ELSE 0 END) AS top1_u, SUMI(CASE WHEN k <= 5 AND net_u > 0 THEN net_u ELSE 0 END) AS top5_u,
            sum(CASE WHEN net_u > 0 THEN (won - 2 * k + 1) * (net_u / 1e6) END) / nullif(max(won) * sum(CASE WHEN net_u > 0 THEN net_u / 1e6 END), 0) AS gini
          FROM (SELECT address, net_u, row_number() OVER (PARTITION BY address ORDER BY net_u DESC, coin, trip) AS k, count(CASE WHEN net_u > 0 THEN 1 END) OVER (PARTITION BY address) AS won FROM {closed_trips}) r GROUP BY address) t
        JOIN (SELECT address, max(net_u) AS best_u FROM (SELECT address, coin, SUMI(net_u) AS net_u FROM {closed_trips} GROUP BY address, coin) x GROUP BY address) c ON t.address = c.address
        JOIN (SELECT address, max(net_u) AS best_u, SUMI(net_u) AS net_u FROM {months} GROUP BY address) m ON t.address = m.address""",
    # a coin's volume up to each day, so that a trip's whole volume is one difference; only coins of little volume a day can be moved
    "d_c3_impact": """
        SELECT address, round(impact_u / nullif(won_u, 0), 6) AS impact_share, CASE WHEN impact_u > $impact_pnl * won_u THEN 'VETO' ELSE 'PASS' END AS severity FROM (
          SELECT address, SUMI(CASE WHEN net_u > 0 THEN net_u ELSE 0 END) AS won_u, SUMI(CASE WHEN net_u > 0 AND own_u > $impact_share * volume_u AND volume_u < $thin_volume * 1e6 * days THEN net_u ELSE 0 END) AS impact_u FROM (
            SELECT t.address, t.net_u, t.traded_u AS own_u, b.upto_u - a.before_u AS volume_u, t.hold + 1 AS days FROM {closed_trips} t JOIN {volumes} a ON t.coin = a.coin AND t.open_day = a.day JOIN {volumes} b ON t.coin = b.coin AND t.close_day = b.day) v GROUP BY address) s""",
    "d_c4": "SELECT address, SUMI(CASE WHEN flag = 'A' THEN pnl_u ELSE 0 END) / 1e6 AS adl_pnl, SUMI(CASE WHEN flag = 'A' THEN 0 ELSE pnl_u END) / 1e6 AS own_pnl, 'INFO' AS severity FROM {fills} GROUP BY address",
    "d_c5": """
        SELECT s.address, round(abs(f.funding_u) / nullif(abs(s.net_u), 0), 6) AS funding_share, CASE WHEN abs(f.funding_u) > $funding_share * abs(s.net_u) AND s.median_hold >= 1 THEN 'FLAG' ELSE 'PASS' END AS severity
        FROM {trip_stats} s JOIN (SELECT address, SUMI(CASE WHEN kind = 'internalTransfer' THEN DIV(usdc_u, 100) ELSE 0 END) AS funding_u FROM {flows} GROUP BY address) f ON s.address = f.address""",
    # the best three windows of so many days that do not touch: each layer adds a window to the best of the layer before that ends early enough
    "d_c8": """
        SELECT address, round(greatest(best, 0) / 1e6, 6) AS best3, round(total_u / 1e6, 6) AS total, CASE WHEN total_u > 0 AND best > $event_share * total_u THEN 'FLAG' ELSE 'PASS' END AS severity FROM (
          SELECT address, max(v3) AS best, max(total_u) AS total_u FROM (
            SELECT *, v1 + greatest(coalesce(max(v2) OVER before, 0), 0) AS v3 FROM (
              SELECT *, v1 + greatest(coalesce(max(v1) OVER before, 0), 0) AS v2 FROM (
                SELECT address, day, CAST(sum(net_u) OVER (PARTITION BY address ORDER BY day RANGE BETWEEN $event_days - 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS v1, CAST(sum(net_u) OVER (PARTITION BY address) AS BIGINT) AS total_u
                FROM (SELECT address, close_day AS day, SUMI(net_u) AS net_u FROM {closed_trips} GROUP BY address, close_day) d) a
              WINDOW before AS (PARTITION BY address ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND $event_days PRECEDING)) b
            WINDOW before AS (PARTITION BY address ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND $event_days PRECEDING)) c GROUP BY address) s""",
    "maker_share": "SELECT address, count(*) AS n_fills, round(avg(CASE WHEN crossed THEN 0.0 ELSE 1.0 END), 6) AS maker_share FROM {fills} GROUP BY address",
    "d_b1": """
        SELECT f.address, round(f.maker, 6) AS maker_share, round(f.per_day, 6) AS trades_per_day, coalesce(g.legs, 0) AS open_legs,
          CASE WHEN f.maker > $maker_max OR f.per_day > $trades_per_day OR s.avg_hold * 86400 < $avg_hold_s OR coalesce(g.legs, 0) > $legs_max THEN 'VETO' ELSE 'PASS' END AS severity
        FROM (SELECT address, avg(CASE WHEN crossed THEN 0.0 ELSE 1.0 END) AS maker, count(*) / count(DISTINCT day) AS per_day FROM {fills} GROUP BY address) f JOIN {trip_stats} s ON f.address = s.address
        LEFT JOIN {most_legs} g ON f.address = g.address""",
    "d_b6": "SELECT address, round(twap, 6) AS twap_share, CASE WHEN twap > $twap_share THEN 'FLAG' ELSE 'PASS' END AS severity FROM (SELECT address, SUMI(CASE WHEN ln = 7 OR ln = 6 OR ln = 5 THEN notional_u ELSE 0 END) / SUMI(notional_u) AS twap FROM {fills} GROUP BY address) t",
    "twap_stats": "SELECT CASE WHEN ln >= 5 THEN 'twap' ELSE 'plain' END AS kind, flag AS status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY CASE WHEN ln >= 5 THEN 'twap' ELSE 'plain' END) AS BIGINT), 6) AS share FROM {fills} GROUP BY CASE WHEN ln >= 5 THEN 'twap' ELSE 'plain' END, flag",
    "fill_profile": """
        SELECT f.address, round(f.buys, 6) AS buy_share, round(c.best / f.volume_u, 6) AS top_coin_volume_share, c.coin AS top_coin, round(f.net_u / f.volume_u, 6) AS net_to_volume, round(f.volume_u / 1e6 / f.n + 1e-9, 6) AS avg_ticket, round(g.gap, 6) AS median_gap
        FROM (SELECT address, count(*) AS n, avg(CASE WHEN dq > 0 THEN 1.0 ELSE 0.0 END) AS buys, SUMI(notional_u) AS volume_u, SUMI(pnl_u - fee_u) AS net_u FROM {fills} GROUP BY address) f
        JOIN (SELECT address, volume_u AS best, coin FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY volume_u DESC, coin) AS k FROM (SELECT address, coin, SUMI(notional_u) AS volume_u FROM {fills} GROUP BY address, coin) v) r WHERE k = 1) c ON f.address = c.address
        LEFT JOIN (SELECT address, median(gap) AS gap FROM {day_gaps} GROUP BY address) g ON f.address = g.address""",
    "direction_bias": "SELECT address, SUMI(CASE WHEN dq > 0 THEN notional_u ELSE 0 END) / 1e6 AS bought, SUMI(CASE WHEN dq < 0 THEN notional_u ELSE 0 END) / 1e6 AS sold, round(SUMI(CASE WHEN dq > 0 THEN notional_u ELSE -notional_u END) / SUMI(notional_u), 6) AS bias FROM {fills} GROUP BY address",
    # by what kind of account and how much it holds
    "cohort_bias": """
        SELECT r.role, CASE WHEN b.value_u >= 5000000000 THEN 'large' WHEN b.value_u >= 0 THEN 'middle' ELSE 'negative' END AS size, count(DISTINCT f.address) AS addresses, round(SUMI(CASE WHEN f.dq > 0 THEN f.notional_u ELSE -f.notional_u END) / SUMI(f.notional_u), 6) AS bias
        FROM {fills} f JOIN {registry} r ON f.address = r.address JOIN {board} b ON f.address = b.address GROUP BY r.role, CASE WHEN b.value_u >= 5000000000 THEN 'large' WHEN b.value_u >= 0 THEN 'middle' ELSE 'negative' END""",
    # what is open at the end of the data, at the coin's last mark: the largest of each coin
    "largest_positions": """
        SELECT coin, place, address, q, notional_u / 1e6 AS notional FROM (
          SELECT b.coin, b.address, b.q, abs(b.q) * m.vwap_u AS notional_u, row_number() OVER (PARTITION BY b.coin ORDER BY abs(b.q) * m.vwap_u DESC, b.address) AS place
          FROM {open_books} b JOIN {last_day} d ON b.until > d.last JOIN {daily_marks} m ON b.coin = m.coin AND m.day = d.last) r WHERE place <= $largest""",
    "min_copy_capital": "SELECT address, round(need, 4) AS min_copy_capital FROM {copy_needs}",
    "anomaly_flags": """
        SELECT s.address, CASE WHEN s.net_u / nullif(r.max_dd * d.top_u, 0) > 1000 THEN 'recovery' WHEN s.win_rate > 1 THEN 'win_rate' WHEN r.max_dd > 1 THEN 'drawdown' ELSE 'none' END AS anomaly
        FROM {trip_stats} s JOIN {risk} r ON s.address = r.address JOIN {day_stats} d ON s.address = d.address""",
    # whether losses are cut: the worst against the median one, and losers closed before twice the median adverse move of losers
    "loss_truncation": """
        SELECT address, losers, round(worst_u / nullif(median_u, 0), 6) AS worst_to_median, round(early, 6) AS cut_early FROM (
          SELECT m.address, count(*) AS losers, max(m.loss_u) AS worst_u, median(m.loss_u) AS median_u, avg(CASE WHEN m.mae_u <= 2 * d.mae_u THEN 1.0 ELSE 0.0 END) AS early FROM {loser_moves} m
          JOIN (SELECT address, median(mae_u) AS mae_u FROM {loser_moves} GROUP BY address) d ON m.address = d.address GROUP BY m.address) t""",
    "tail_ratio": """
        SELECT address, n, round(high / nullif(abs(low), 0), 6) AS tail_ratio FROM (SELECT address, count(*) AS n, PCTL(net_u / 1e6, 0.95) AS high, PCTL(net_u / 1e6, 0.05) AS low FROM {closed_trips} GROUP BY address) t""",
    # regular timing has few sizes of pauses: entropy over their powers of two
    "timing_entropy": """
        SELECT address, SUMI(n) AS pauses, round(-sum(n / total * ln(n / total)), 6) AS entropy FROM (
          SELECT address, size, n, CAST(sum(n) OVER (PARTITION BY address) AS BIGINT) AS total FROM (
            SELECT address, floor(round(ln(greatest(gap, 1)) / ln(2), 9)) AS size, count(*) AS n FROM (SELECT address, ms - lag(ms) OVER (PARTITION BY address ORDER BY ms, id) AS gap FROM {actions}) g WHERE gap IS NOT NULL GROUP BY address, floor(round(ln(greatest(gap, 1)) / ln(2), 9))) c) e GROUP BY address""",
    "recovery_factor": "SELECT s.address, round(s.net_u / nullif(r.max_dd * d.top_u, 0), 6) AS recovery_factor FROM {trip_stats} s JOIN {risk} r ON s.address = r.address JOIN {day_stats} d ON s.address = d.address",
    "funding_alloc": """
        SELECT t.address, t.coin, t.trip, count(*) AS n_payments, SUMI(f.usdc_u) / 1e6 AS funding
        FROM {closed_trips} t JOIN {flows} f ON t.address = f.address AND f.kind = 'internalTransfer' AND f.day BETWEEN t.open_day AND t.close_day GROUP BY t.address, t.coin, t.trip""",
}

VIEWS = {
    # trips by the blocks of days that they touch, and marks by theirs: a hot coin's trips meet its marks in as many places as it has blocks
    "trip_blocks": "SELECT *, SEQ(DIV(open_day, 32), DIV(close_day, 32)) AS block FROM {closed_trips}",
    "mark_blocks": "SELECT *, DIV(day, 32) AS block FROM {marks}",
    # losing trips, and how far their coin went against them
    "loser_moves": """
        SELECT t.address, t.coin, t.trip, max(-t.net_u) AS loss_u, max(greatest(0, CASE WHEN t.side = 'long' THEN DIV(t.in_u, t.in_q) - m.low_u ELSE m.high_u - DIV(t.in_u, t.in_q) END)) AS mae_u
        FROM {trip_blocks} t JOIN {mark_blocks} m ON t.coin = m.coin AND t.block = m.block AND m.day BETWEEN t.open_day AND t.close_day WHERE t.net_u < 0 GROUP BY t.address, t.coin, t.trip""",
    # orders that stood before the market reached them
    "trigger_orders": "SELECT DISTINCT id AS ok FROM {flows} WHERE priority = '1-URGENT'",
    # the most coins open at the end of one day
    "most_legs": """
        SELECT address, max(legs) AS legs FROM (SELECT address, day, CAST(sum(d) OVER (PARTITION BY address ORDER BY day) AS BIGINT) AS legs FROM (
          SELECT address, day, SUMI(d) AS d FROM (SELECT address, day, 1 AS d FROM {open_books} UNION ALL SELECT address, until, -1 FROM {open_books}) u GROUP BY address, day) s) g GROUP BY address""",
    "copy_needs": "SELECT f.address, max($copy_ticket * e.equity_u / f.notional_u) AS need FROM {fills} f JOIN {equity} e ON f.address = e.address AND f.day = e.day GROUP BY f.address",
    "volumes": "SELECT coin, day, upto_u, upto_u - volume_u AS before_u FROM (SELECT coin, day, volume_u, CAST(sum(volume_u) OVER (PARTITION BY coin ORDER BY day) AS BIGINT) AS upto_u FROM {marks}) v",
}

_EXCURSIONS = """
        SELECT t.address, t.coin, t.trip, round(min(CASE WHEN t.side = 'long' THEN m.low_u - DIV(t.in_u, t.in_q) ELSE DIV(t.in_u, t.in_q) - m.high_u END) / 1e6, 6) AS mae,
          round(max(CASE WHEN t.side = 'long' THEN m.high_u - DIV(t.in_u, t.in_q) ELSE DIV(t.in_u, t.in_q) - m.low_u END) / 1e6, 6) AS mfe
        FROM %s AND m.day BETWEEN t.open_day AND t.close_day GROUP BY t.address, t.coin, t.trip"""
#: name -> (DataFrame plan, oracle text)
PLANS = {
    "mae_mfe": (
        lambda t: t.sql(_EXCURSIONS % "{trip_blocks} t JOIN {mark_blocks} m ON t.coin = m.coin AND t.block = m.block"),
        _EXCURSIONS % "{closed_trips} t JOIN {marks} m ON t.coin = m.coin",
    ),
}
