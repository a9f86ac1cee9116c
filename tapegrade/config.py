"""Thresholds of the gates, detectors and screens; every query takes them from here."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Config:
    """Defaults; ratios as fractions, money in dollars, spans in days unless named otherwise."""

    # track record and regularity
    min_history: int = 180
    months_required: int = 6
    coverage_min: float = 0.90
    late_start_months: int = 3
    missing_days: int = 2
    archive_months: int = 48
    weeks_min: float = 0.60
    week_days: int = 3
    longest_gap: int = 21
    # holding times: the mapped fills have days, the golden wallets seconds
    hold_low_s: int = 300
    hold_high_s: int = 28_800
    day_close_share: float = 0.70
    avg_hold_s: int = 180
    maker_max: float = 0.80
    trades_per_day: int = 300
    requests_per_fill: float = 50.0
    history_cap: int = 10_000
    forward_days: int = 30
    watch_days: int = 30
    envelope: float = 1.5
    legs_max: int = 5
    # results
    months_positive: float = 4 / 6
    month_share: float = 0.40
    top5_share: float = 0.35
    max_dd: float = 0.30
    leverage_max: float = 10.0
    margin_p95: float = 0.80
    liq_recent: int = 0
    liq_lifetime: int = 1
    tstat_min: float = 2.0
    dsr_min: float = 0.90
    equity_floor: float = 5_000.0
    # rolling periods: days, calendar months, and returns that a period needs for a t-statistic
    rolling_days: int = 180
    rolling_months: int = 6
    rolling_least: int = 4
    rolling_over: float = 0.05
    # detectors
    flow_share: float = 0.5
    rescue_inflow: float = 0.15
    rescue_upnl: float = -0.25
    rescue_window_s: int = 3_600
    rescue_span: int = 180
    rescue_distance: float = 0.10
    max_leverage: float = 20.0
    zombie_upnl: float = -0.20
    zombie_days: int = 3
    zombie_equity: float = 0.30
    event_days: int = 7
    event_share: float = 0.8
    edge_days: int = 3
    edge_share: float = 0.4
    edge_losses: int = 10
    net_to_gross: float = 0.2
    flat_beta: float = 0.1
    carry_days: float = 0.8
    carry_cv: float = 0.25
    transfer_link: float = 30_000.0
    evidence: int = 3
    income_share: float = 0.20
    hedge_ratio: float = 0.3
    wash_share: float = 0.05
    sybil_wallets: int = 3
    sybil_days: int = 14
    twin_seconds: int = 60
    twin_notional: float = 0.25
    twin_events: int = 5
    opposed_rho: float = -0.8
    opposed_days: int = 3
    underwater_share: float = 0.5
    size_multiple: float = 3.0
    martingale_trips: float = 0.10
    disposition: float = 3.0
    payoff_min: float = 0.3
    leverage_spike: float = 2.0
    leverage_veto: float = 25.0
    tilt_max: float = 1.5
    impact_share: float = 0.20
    impact_pnl: float = 0.25
    thin_volume: float = 5_000_000.0
    funding_share: float = 0.5
    copier_low_s: int = 5
    copier_high_s: int = 120
    copier_share: float = 0.70
    copier_opens: int = 10
    twap_share: float = 0.40
    flock_s: int = 900
    flag_penalty: int = 5
    family_cap: int = 15
    qa_families: int = 3
    # screens
    screen_equity: float = 10_000.0
    screen_volume_all: float = 1_000_000.0
    screen_volume_30d: float = 100_000.0
    active_days: int = 60
    copy_ticket: float = 10.0
    sleeve: float = 10_000.0
    sleeve_trips: int = 100
    sleeve_margin: float = 0.90
    churn: float = 20.0
    two_sided: float = 0.10
    promote: int = 60
    largest: int = 3
    stored_fills: int = 40
    check_diff: float = 0.01
    weight_per_minute: int = 1_080

    def literals(self) -> dict[str, str]:
        return {k: repr(v) for k, v in asdict(self).items()}


DEFAULT = Config()
