"""Readers of landed answers about accounts and markets, against rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tapegrade.sources import accounts, payloads


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def position(coin, szi, value, liq, unrealized="0", margin="10", kind="cross"):
    return {"type": "oneWay", "position": {"coin": coin, "szi": szi, "entryPx": "9", "positionValue": value, "unrealizedPnl": unrealized, "liquidationPx": liq, "marginUsed": margin, "maxLeverage": 20, "leverage": {"type": kind, "value": 5}}}


def state(*positions, equity="100"):
    return {"marginSummary": {"accountValue": equity, "totalNtlPos": "300", "totalRawUsd": "1", "totalMarginUsed": "30"}, "crossMaintenanceMarginUsed": "5", "withdrawable": "7", "assetPositions": list(positions)}


def test_states_of_both_shapes(spark, tmp_path):
    one = lines(tmp_path / "o", [{"user": "0xA", "time": 1, "state": state(position("BTC", "2", "20", "8"), position("ETH", "-4", "40", None), position("X", "0", "0", None))}] * 2)
    every = lines(tmp_path / "e", [{"user": "0xa", "time": 1, "clearinghouseStates": [["xyz", state(position("xyz:T", "-1", "10", "12"), equity="50")], [None, None]]}, {"user": "0xB", "time": 2, "clearinghouseStates": []}, {"user": "0xC", "time": 2}, "{broken"])
    found = accounts.states(spark, one, every)
    got = {(r["address"], r["dex"], r["coin"]): (float(r["szi"]), r["distance"]) for r in accounts.positions(found).collect()}
    assert got == {("0xa", "", "BTC"): (2, pytest.approx(0.2)), ("0xa", "", "ETH"): (-4, None), ("0xa", "xyz", "xyz:T"): (-1, pytest.approx(0.2))}
    assert [(r["address"], float(r["equity"]), float(r["notional"])) for r in accounts.margins(found).collect()] == [("0xa", 150.0, 600.0)]


def test_margin_added_under_water_at_the_same_size(spark, tmp_path):
    rows = [("1", "-5", "10"), ("1", "-6", "14"), ("2", "-6", "20"), ("2", "3", "25"), ("2", "-1", "24")]
    path = lines(tmp_path / "o", [{"user": "0xA", "time": t, "state": state(position("BTC", szi, "20", "8", u, m, "isolated"))} for t, (szi, u, m) in enumerate(rows)])
    got = accounts.margin_topups(accounts.positions(accounts.states(spark, path))).collect()
    assert [(r["time"], float(r["added"])) for r in got] == [(1, 4.0)]


def test_spot_balances_and_vaults(spark, tmp_path):
    spot = lines(tmp_path / "s", [{"user": "0xA", "time": 1, "balances": [{"coin": "USDC", "total": "5", "hold": "1", "entryNtl": "0"}, {"coin": "T", "total": "2", "hold": "0"}]}, {"user": "0xB", "time": 1, "balances": None}])
    assert {(r["coin"], float(r["total"])) for r in accounts.balances(spark, spot).collect()} == {("USDC", 5), ("T", 2)}
    vaults = lines(tmp_path / "v", [{"user": "0xA", "time": 1, "equities": [{"vaultAddress": "0xV", "equity": "3"}]}])
    assert [(r["vault"], float(r["equity"])) for r in accounts.vault_equities(spark, vaults).collect()] == [("0xv", 3.0)]


def test_portfolio_histories_meet_by_time_and_the_newest_answer_counts(spark, tmp_path):
    old = {"accountValueHistory": [[1, "10"], [2, "11"]], "pnlHistory": [[1, "0"]], "vlm": "9"}
    new = {"accountValueHistory": [[2, "12"]], "pnlHistory": [[2, "1"], [3, "2"]]}
    path = lines(tmp_path / "p", [{"user": "0xA", "time": 5, "portfolio": [["perpAllTime", old], ["day", old]]}, {"user": "0xA", "time": 6, "portfolio": [["perpAllTime", new]]}, {"user": "0xB", "time": 6, "portfolio": []}])
    number = lambda v: None if v is None else float(v)
    got = {(r["span"], r["perp"], r["time"]): (number(r["account_value"]), number(r["pnl"])) for r in accounts.portfolio(spark, path).collect()}
    assert got == {("allTime", True, 1): (10, 0), ("allTime", True, 2): (12, 1), ("allTime", True, 3): (None, 2), ("day", False, 1): (10, 0), ("day", False, 2): (11, None)}


def test_hierarchy_edges(spark, tmp_path):
    subs = lines(tmp_path / "s", [{"user": "0xM", "subAccounts": [{"subAccountUser": "0xS1", "master": "0xM"}, {"subAccountUser": "0xS2"}]}, {"user": "0xN", "subAccounts": None}])
    role = lines(tmp_path / "r", [{"user": "0xS1", "role": "subAccount", "data": {"master": "0xm"}}, {"user": "0xG", "role": "agent", "data": {"user": "0xM"}}, {"user": "0xM", "role": "user"}])
    agents = lines(tmp_path / "a", [{"user": "0xM", "extraAgents": [{"name": "bot", "address": "0xG", "validUntil": 1}]}] * 2)
    signers = lines(tmp_path / "m", [{"user": "0xW", "authorizedUsers": ["0xM", "0xW"], "threshold": 2}])
    vaults = lines(tmp_path / "v", [{"vaultAddress": "0xV", "leader": "0xM"}])
    got = sorted(tuple(r) for r in accounts.hierarchy(spark, subs, role, agents, signers, vaults).collect())
    assert got == [("0xm", "0xg", "agent"), ("0xm", "0xs1", "subAccount"), ("0xm", "0xs2", "subAccount"), ("0xm", "0xv", "vault"), ("0xm", "0xw", "signer")]
    assert {r["address"]: r["master"] for r in accounts.roles(spark, role).collect()} == {"0xs1": "0xm", "0xg": "0xm", "0xm": None}


def test_action_log(spark, tmp_path):
    tx = lambda h, action, **more: {"time": 1, "block": 2, "hash": h, "error": None, "action": action} | more
    path = lines(tmp_path / "d", [{"user": "0xA", "txs": [tx("1", {"type": "updateIsolatedMargin", "asset": 3, "isBuy": True, "ntli": 5_000_000}), tx("2", {"type": "order", "orders": [{"a": 1}, {"a": 2}]}), tx("3", {"type": "updateLeverage", "asset": 1, "isCross": False, "leverage": 10}, error="no")]}, {"user": "0xA", "txs": [tx("2", {"type": "order", "orders": [{"a": 1}, {"a": 2}]})]}])
    got = {r["hash"]: (r["type"], r["added"], r["leverage"], r["requests"], r["failed"]) for r in accounts.actions(spark, path).collect()}
    assert got == {"1": ("updateIsolatedMargin", 5.0, None, 0, False), "2": ("order", None, None, 2, False), "3": ("updateLeverage", None, 10, 0, True)}


def test_market_and_maintenance_margin(spark, tmp_path):
    tiers = {"description": "t", "marginTiers": [{"lowerBound": "0", "maxLeverage": 10}, {"lowerBound": "1000", "maxLeverage": 5}]}
    path = lines(tmp_path / "m", [{"dex": "", "time": 1, "meta": {"universe": [{"name": "BTC", "szDecimals": 5, "maxLeverage": 10, "marginTableId": 7}, {"name": "OLD", "maxLeverage": 3, "marginTableId": 7, "isDelisted": True}], "marginTables": [[7, tiers]]}, "contexts": [{"funding": "0.0001", "openInterest": "12", "markPx": "2"}]}])
    got = {r["coin"]: (r["max_leverage"], r["delisted"], None if r["open_interest"] is None else float(r["open_interest"])) for r in accounts.coins(spark, path).collect()}
    assert got == {"BTC": (10, False, 12.0), "OLD": (3, True, None)}
    table = accounts.margin_tiers(spark, path).crossJoin(spark.createDataFrame([(500.0,), (3000.0,)], "n double"))
    # 5 % of the first thousand, 10 % of the rest
    assert {r[0]: r[1] for r in table.select("n", accounts.maintenance(F.col("n"), F.col("tiers"))).collect()} == {500.0: pytest.approx(25.0), 3000.0: pytest.approx(250.0)}


def test_funding(spark, tmp_path):
    history = lines(tmp_path / "h", [{"coin": "BTC", "time": t, "fundingRate": "0.01", "premium": "0"} for t in (0, 3_600_000, 3_600_000, 86_400_000)])
    assert sorted((str(r["day"]), round(r["rate"], 9), r["hours"]) for r in accounts.funding_regime(spark, history).collect()) == [("1970-01-01", 0.02, 2), ("1970-01-02", 0.01, 1)]
    paid = lines(tmp_path / "p", [{"user": "0xA", "time": 1, "hash": "0", "delta": {"type": "funding", "coin": "BTC", "usdc": "-2", "szi": "1", "fundingRate": "0.1"}}] * 2)
    assert [(r["address"], float(r["usdc"])) for r in accounts.funding_payments(spark, paid).collect()] == [("0xa", -2.0)]


def test_debt_known_at_a_moment_is_taken_off(spark, tmp_path):
    owed = lines(tmp_path / "b", [{"user": "0xA", "time": 2, "tokenToState": [["USDC", {"borrow": {"value": "40"}, "supply": {"value": "1"}}], ["T", {"supply": {"value": "5"}}]]}, {"user": "0xA", "time": 4, "tokenToState": [["USDC", {"borrow": {"value": "100"}}]]}])
    states = lines(tmp_path / "s", [{"user": "0xA", "time": t, "state": state()} for t in (1, 2, 3, 4)])
    got = accounts.own_equity(accounts.margins(accounts.states(spark, states)), accounts.debts(spark, owed)).collect()
    assert {r["time"]: (float(r["own_equity"]), r["leverage"]) for r in got} == {1: (100, 3.0), 2: (60, 5.0), 3: (60, 5.0), 4: (0, None)}


def test_requests_and_twaps(spark, tmp_path):
    limits = lines(tmp_path / "l", [{"user": "0xA", "time": t, "cumVlm": "5", "nRequestsUsed": 10 * t, "nRequestsCap": 100} for t in (2, 1)])
    assert [(r["requests"], r["cap"]) for r in accounts.request_load(spark, limits).collect()] == [(20, 100)]
    twaps = lines(tmp_path / "t", [{"user": "0xA", "twaps": [{"time": 1, "state": {"coin": "BTC", "side": "B", "sz": "4", "executedSz": "3", "executedNtl": "30", "minutes": 5, "reduceOnly": False}, "status": {"status": "terminated"}}]}])
    assert [(r["coin"], float(r["executed"]), r["status"]) for r in accounts.twaps(spark, twaps).collect()] == [("BTC", 3.0, "terminated")]


def test_chain_transfers_and_funders(spark, tmp_path):
    pad = lambda a: "0x" + "0" * 24 + a * 40
    log = lambda n, src, dst, units, **more: {"address": "0xTok", "topics": [accounts.TRANSFER_TOPIC, pad(src), pad(dst)], "data": "0x" + f"{units:064x}", "blockNumber": hex(n), "transactionHash": f"h{n}", "logIndex": "0x0"} | more
    path = lines(tmp_path / "l", [log(9, "b", "a", 1_000_000), log(5, "c", "a", 2_500_000), log(5, "c", "a", 2_500_000), log(6, "d", "e", 1), log(7, "a", "a", 5), log(8, "a", "f", 2**200), log(3, "d", "a", 7, address="0xOther"), log(2, "d", "a", 7, topics=["0x1", pad("d"), pad("a")])])
    moved = accounts.chain_transfers(spark, path, "0xTOK")
    assert sorted((r["src"][2], r["dst"][2], None if r["amount"] is None else float(r["amount"]), r["block"]) for r in moved.collect()) == [("a", "a", 5e-6, 7), ("a", "f", None, 8), ("b", "a", 1.0, 9), ("c", "a", 2.5, 5), ("d", "e", 1e-6, 6)]
    exchange = spark.createDataFrame([("0x" + "D" * 40,)], "address string")
    assert [(r["address"][2], r["funder"][2]) for r in accounts.funders(moved, exchange).collect()] == [("a", "c")]


def entry(kind, user="0xA", time=1, **d):
    return {"user": user, "time": time, "hash": kind, "delta": {"type": kind, **d}}


def test_every_ledger_type_has_a_flow(spark, tmp_path):
    path = lines(tmp_path / "l", [
        entry("vaultCreate", usdc="7", vault="0xV"), entry("vaultDeposit", usdc="2", vault="0xV"), entry("vaultWithdraw", requestedUsd="4", netWithdrawnUsd="3", vault="0xV"), entry("borrowLend", operation="borrow", token="USDC", amount="5"),
        entry("liquidation", liquidatedNtlPos="9", accountValue="1", leverageType="Cross", liquidatedPositions=[{"coin": "BTC", "szi": "1"}]), entry("spotGenesis", token="T", amount="6"), entry("deployGasAuction", token="T", amount="6"), entry("activateDexAbstraction"),
        entry("send", user="0xA", destination="0xa", amount="8", **{"token": "T"}), entry("cStakingTransfer", amount="1"), entry("brandNew", usdc="1"),
    ])
    got = {r["type"]: (None if r["flow"] is None else float(r["flow"]), r["income"]) for r in payloads.ledger_flows(spark, path).collect()}
    assert got == {"vaultCreate": (-7, False), "vaultDeposit": (-2, False), "vaultWithdraw": (3, False), "borrowLend": (5, False), "liquidation": (0, False), "spotGenesis": (0, False), "deployGasAuction": (0, False), "activateDexAbstraction": (0, False), "send": (8, False), "cStakingTransfer": (0, True), "brandNew": (None, False)}
    assert [(r["address"], float(r["notional"]), r["coin"], float(r["szi"])) for r in payloads.liquidations(spark, path).collect()] == [("0xa", 9.0, "BTC", 1.0)]


def test_transfers_of_both_ledgers_count_once_and_within_an_address_not(spark, tmp_path):
    sent = {"type": "internalTransfer", "usdc": "4", "user": "0xA", "destination": "0xB"}
    rows = [{"user": u, "time": 1, "hash": "h", "delta": sent} for u in ("0xA", "0xB")]
    own = {"user": "0xA", "time": 2, "hash": "i", "delta": {"type": "send", "usdcValue": "9", "amount": "3", "user": "0xA", "destination": "0xA"}}
    path = lines(tmp_path / "l", [*rows, own, entry("vaultDeposit", usdc="2", vault="0xV")])
    assert sorted((r["address"], r["type"], float(r["flow"])) for r in payloads.ledger_flows(spark, path).collect()) == [("0xa", "internalTransfer", -4), ("0xa", "send", 0), ("0xa", "vaultDeposit", -2), ("0xb", "internalTransfer", 4)]
    assert sorted((r["src"], r["dst"], r["n"], float(r["usdc"])) for r in payloads.ledger_links(spark, path).collect()) == [("0xa", "0xb", 1, 4.0), ("0xa", "0xv", 1, 2.0)]


def test_archive_by_folder_and_fuller_shape_first(spark, tmp_path):
    fill = {"coin": "BTC", "px": "1", "sz": "2", "side": "B", "time": 5, "fee": "0.1", "tid": 1}
    for name, row in (("node_trades", {"coin": "BTC", "side": "B", "time": 5, "px": "1", "sz": "2", "tid": 1, "side_info": [{"user": "0xA"}, {"user": "0xB"}]}), ("node_fills_by_block", {"block_number": 1, "events": [{"user": "0xA", "fill": fill}]})):
        (tmp_path / name / "20250102").mkdir(parents=True)
        lines(tmp_path / name / "20250102" / "f", [row])
    paths = [str(tmp_path / n / "20250102") for n in ("node_trades", "node_fills_by_block")]
    assert {(r["address"], r["fee"] is None) for r in payloads.archive_fills(spark, paths).collect()} == {("0xa", False), ("0xb", True)}
    page = lines(tmp_path / "page", [{"user": "0xB", **fill, "fee": "0.3"}])
    assert {(r["address"], float(r["fee"])) for r in payloads.fills(spark, node_trades=paths[0], by_block=paths[1], paged=page).collect()} == {("0xa", 0.1), ("0xb", 0.3)}
    with pytest.raises(ValueError):
        payloads.archive_fills(spark, ["/x/other"])
    work = spark.createDataFrame([("/x/node_fills/20240101/a",), ("/x/node_trades/20250102.lz4",), ("/x/node_fills/20250102/b",), ("/x/readme",)], "path string")
    assert sorted((r["shape"], str(r["day"]), r["turn"]) for r in payloads.archive_work(spark, work).collect()) == [("node_fills", "2024-01-01", 2), ("node_fills", "2025-01-02", 1), ("node_trades", "2025-01-02", 1)]
