"""Landed payloads about accounts and markets: state, portfolio, hierarchy, action log, market data, funding, chain transfers.

A line is one answer with the address and the moment it was asked for. Answers that mix types in an array (pairs of a name and an object, of a time and a number)
are read as texts and parsed when their place in the pair is known; numbers come as texts or numbers and are read as decimals. Null or missing parts give no rows; repeated answers give their rows once where a row has an
identity of its own (an action, a transfer, a funding payment), and one a moment otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrade.sources.payloads import MONEY, SCHEMAS, address, read

_SUMMARY = f"struct<accountValue: {MONEY}, totalNtlPos: {MONEY}, totalRawUsd: {MONEY}, totalMarginUsed: {MONEY}>"
_POSITION = f"struct<coin: string, szi: {MONEY}, entryPx: {MONEY}, positionValue: {MONEY}, unrealizedPnl: {MONEY}, liquidationPx: {MONEY}, marginUsed: {MONEY}, maxLeverage: int, leverage: struct<type: string, value: int>>"
_STATE = f"struct<marginSummary: {_SUMMARY}, crossMaintenanceMarginUsed: {MONEY}, withdrawable: {MONEY}, assetPositions: array<struct<position: {_POSITION}>>>"

SCHEMAS |= {
    "state": f"user string, time long, dex string, state {_STATE}",
    "all_dexs_state": "user string, time long, clearinghouseStates array<array<string>>",
    "spot_state": f"user string, time long, balances array<struct<coin: string, total: {MONEY}, hold: {MONEY}, entryNtl: {MONEY}>>",
    "portfolio": "user string, time long, portfolio array<array<string>>",
    "sub_accounts": "user string, subAccounts array<struct<subAccountUser: string, master: string>>",
    "role": "user string, role string, data struct<master: string, user: string>",
    "agents": "user string, extraAgents array<struct<name: string, address: string, validUntil: long>>",
    "signers": "user string, authorizedUsers array<string>, threshold int",
    "vault": "vaultAddress string, leader string",
    "user_details": f"user string, txs array<struct<time: long, block: long, hash: string, error: string, action: struct<type: string, asset: int, isBuy: boolean, ntli: long, isCross: boolean, leverage: int, orders: array<string>, cancels: array<string>, modifies: array<string>>>>",
    "market": f"dex string, time long, meta struct<universe: array<struct<name: string, szDecimals: int, maxLeverage: int, marginTableId: int, onlyIsolated: boolean, isDelisted: boolean>>, marginTables: array<array<string>>>, contexts array<struct<funding: {MONEY}, openInterest: {MONEY}, markPx: {MONEY}, oraclePx: {MONEY}, dayNtlVlm: {MONEY}>>",
    "funding_history": f"coin string, time long, fundingRate {MONEY}, premium {MONEY}",
    "user_funding": f"user string, time long, hash string, delta struct<coin: string, usdc: {MONEY}, szi: {MONEY}, fundingRate: {MONEY}>",
    "rate_limit": f"user string, time long, cumVlm {MONEY}, nRequestsUsed long, nRequestsCap long",
    "vault_equities": f"user string, time long, equities array<struct<vaultAddress: string, equity: {MONEY}>>",
    "borrows": "user string, time long, tokenToState array<array<string>>",
    "twap_history": f"user string, twaps array<struct<time: long, state: struct<coin: string, side: string, sz: {MONEY}, executedSz: {MONEY}, executedNtl: {MONEY}, minutes: int, reduceOnly: boolean>, status: struct<status: string>>>",
    "transfer_logs": "address string, topics array<string>, data string, blockNumber string, transactionHash string, logIndex string",
}

#: Topic of an ERC-20 transfer event (fixed value).
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
#: Action types that place, cancel or change orders, by the field that lists them.
REQUESTS = {"order": "orders", "cancel": "cancels", "cancelByCloid": "cancels", "batchModify": "modifies"}


def states(spark: SparkSession, one_dex: str | None = None, all_dexs: str | None = None) -> DataFrame:
    """(address, time, dex, state) of both shapes of answer; the first dex has an empty name. One row a (address, time, dex)."""
    parts = []
    if one_dex:
        parts.append(read(spark, one_dex, "state").select(address(F.col("user")).alias("address"), "time", F.coalesce("dex", F.lit("")).alias("dex"), "state"))
    if all_dexs:
        pairs = read(spark, all_dexs, "all_dexs_state").select(address(F.col("user")).alias("address"), "time", F.explode("clearinghouseStates").alias("p"))
        parts.append(pairs.select("address", "time", F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("dex"), F.from_json(F.get("p", F.lit(1)), _STATE).alias("state")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("state IS NOT NULL").dropDuplicates(["address", "time", "dex"])


def positions(states: DataFrame) -> DataFrame:
    """A row an open position of ``states``, with the share that marks may fall (or rise) to its liquidation price; null without one."""
    p = F.col("p.position")
    mark = F.abs(p["positionValue"] / F.nullif(p["szi"], F.lit(0)))
    away = F.when(p["szi"] > 0, mark - p["liquidationPx"]).otherwise(p["liquidationPx"] - mark)
    found = states.select("address", "time", "dex", F.explode("state.assetPositions").alias("p")).filter(p["szi"] != 0)
    kept = [p[c].alias(n) for c, n in (("coin", "coin"), ("szi", "szi"), ("entryPx", "entry_px"), ("positionValue", "notional"), ("unrealizedPnl", "unrealized"), ("marginUsed", "margin_used"), ("maxLeverage", "max_leverage"))]
    return found.select("address", "time", "dex", *kept, p["leverage"]["value"].alias("leverage"), (p["leverage"]["type"] == "isolated").alias("isolated"), (away / F.nullif(mark, F.lit(0))).cast("double").alias("distance"))


def margins(states: DataFrame) -> DataFrame:
    """(address, time, equity, notional, margin_used, withdrawable) summed over dexes."""
    m = F.col("state.marginSummary")
    return states.groupBy("address", "time").agg(F.sum(m["accountValue"]).alias("equity"), F.sum(m["totalNtlPos"]).alias("notional"), F.sum(m["totalMarginUsed"]).alias("margin_used"), F.sum("state.withdrawable").alias("withdrawable"))


def margin_topups(positions: DataFrame) -> DataFrame:
    """Isolated positions under water whose margin rose from one state to the next while their size stayed: address, time, coin, added."""
    w = W.partitionBy("address", "dex", "coin").orderBy("time")
    seen = positions.filter("isolated").withColumn("before", F.lag(F.struct("szi", "margin_used")).over(w))
    added = F.col("margin_used") - F.col("before.margin_used")
    return seen.filter((F.col("szi") == F.col("before.szi")) & (F.col("unrealized") < 0) & (added > 0)).select("address", "time", "coin", added.alias("added"))


def balances(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, coin, total, hold): a row a spot balance."""
    return read(spark, path, "spot_state").select(address(F.col("user")).alias("address"), "time", F.inline("balances")).select("address", "time", "coin", "total", "hold").dropDuplicates(["address", "time", "coin"])


def portfolio(spark: SparkSession, path: str) -> DataFrame:
    """(address, span, perp, time, account_value, pnl) of every point of the histories; a moment that one history lacks is null there.

    Spans of perpetuals alone (``perpDay`` and so on) have ``perp`` true and the span's plain name. Answers overlap, so the newest one that has a moment counts.
    """
    pair = read(spark, path, "portfolio").select(address(F.col("user")).alias("address"), F.col("time").alias("asked"), F.explode("portfolio").alias("p"))
    histories = "struct<accountValueHistory: array<array<string>>, pnlHistory: array<array<string>>>"
    name = F.get("p", F.lit(0))
    pair = pair.select("address", "asked", name.startswith("perp").alias("perp"), F.regexp_replace(name, "^perp", "").alias("s"), F.from_json(F.get("p", F.lit(1)), histories).alias("h"))
    pair = pair.select("address", "asked", "perp", F.concat(F.lower(F.left("s", F.lit(1))), F.expr("substring(s, 2)")).alias("span"), "h")
    no = F.array().cast("array<array<string>>")
    told = lambda column, k: F.transform(F.coalesce(F.col(column), no), lambda x: F.struct(F.lit(k).alias("k"), F.get(x, F.lit(0)).cast("long").alias("time"), F.get(x, F.lit(1)).cast(MONEY).alias("value")))
    points = pair.select("address", "asked", "perp", "span", F.inline(F.concat(told("h.accountValueHistory", 0), told("h.pnlHistory", 1)))).filter("time IS NOT NULL")
    last = lambda k: F.max_by(F.when(F.col("k") == k, F.col("value")), F.when((F.col("k") == k) & F.col("value").isNotNull(), F.struct("asked", "value")))
    return points.groupBy("address", "span", "perp", "time").agg(last(0).alias("account_value"), last(1).alias("pnl"))


def roles(spark: SparkSession, path: str) -> DataFrame:
    """(address, role, master): whom an agent or a subaccount belongs to, null for others."""
    return read(spark, path, "role").select(address(F.col("user")).alias("address"), "role", address(F.coalesce("data.master", "data.user")).alias("master")).distinct()


def hierarchy(spark: SparkSession, sub_accounts: str | None = None, roles_path: str | None = None, agents: str | None = None, signers: str | None = None, vaults: str | None = None) -> DataFrame:
    """Hard links (src, dst, edge_type): from the one in charge to what it controls. Each once, none from an address to itself."""
    parts = []
    if sub_accounts:
        parts.append(read(spark, sub_accounts, "sub_accounts").select("user", F.explode("subAccounts").alias("s")).select(F.coalesce("s.master", "user").alias("src"), F.col("s.subAccountUser").alias("dst"), F.lit("subAccount").alias("edge_type")))
    if roles_path:
        parts.append(roles(spark, roles_path).select(F.col("master").alias("src"), F.col("address").alias("dst"), F.col("role").alias("edge_type")))
    if agents:
        parts.append(read(spark, agents, "agents").select(F.col("user").alias("src"), F.explode("extraAgents.address").alias("dst"), F.lit("agent").alias("edge_type")))
    if signers:
        parts.append(read(spark, signers, "signers").select(F.explode("authorizedUsers").alias("src"), F.col("user").alias("dst"), F.lit("signer").alias("edge_type")))
    if vaults:
        parts.append(read(spark, vaults, "vault").select(F.col("leader").alias("src"), F.col("vaultAddress").alias("dst"), F.lit("vault").alias("edge_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst"), "edge_type").filter("src <> dst").distinct()


def actions(spark: SparkSession, path: str) -> DataFrame:
    """Action log, each (address, hash) once: time, block, type, asset, added (dollars of an isolated margin update), leverage, is_cross, requests (orders, cancels and changes in it), failed."""
    a = F.col("t.action")
    requests = F.lit(0)
    for kind, field in REQUESTS.items():
        requests = F.when(a["type"] == kind, F.coalesce(F.size(a[field]), F.lit(0))).otherwise(requests)
    added = F.when(a["type"] == "updateIsolatedMargin", a["ntli"] / 1e6)
    log = read(spark, path, "user_details").select(address(F.col("user")).alias("address"), F.explode("txs").alias("t"))
    out = log.select("address", "t.time", "t.block", "t.hash", a["type"].alias("type"), a["asset"].alias("asset"), added.alias("added"), a["leverage"].alias("leverage"), a["isCross"].alias("is_cross"), requests.alias("requests"), F.col("t.error").isNotNull().alias("failed"))
    return out.dropDuplicates(["address", "hash"])


def coins(spark: SparkSession, path: str) -> DataFrame:
    """(dex, time, coin, max_leverage, margin_table, only_isolated, delisted, funding, open_interest, mark_px): contexts belong to coins by their place."""
    u = F.col("u")
    listed = read(spark, path, "market").select("dex", "time", "contexts", F.posexplode("meta.universe").alias("k", "u"))
    context = F.get("contexts", F.col("k"))
    out = listed.select(F.coalesce("dex", F.lit("")).alias("dex"), "time", u["name"].alias("coin"), u["maxLeverage"].alias("max_leverage"), u["marginTableId"].alias("margin_table"), F.coalesce(u["onlyIsolated"], F.lit(False)).alias("only_isolated"), F.coalesce(u["isDelisted"], F.lit(False)).alias("delisted"), context["funding"].cast("double").alias("funding"), context["openInterest"].alias("open_interest"), context["markPx"].alias("mark_px"))
    return out.dropDuplicates(["dex", "time", "coin"])


def margin_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(dex, margin_table, tiers) of the newest answer a table: tiers hold the notional they start at and by how much the maintenance rate, half of the initial one, rises there."""
    tables = read(spark, path, "market").select(F.coalesce("dex", F.lit("")).alias("dex"), "time", F.explode("meta.marginTables").alias("p"))
    parsed = tables.select("dex", F.get("p", F.lit(0)).cast("int").alias("margin_table"), "time", F.from_json(F.get("p", F.lit(1)), f"struct<marginTiers: array<struct<lowerBound: {MONEY}, maxLeverage: int>>>").alias("t"))
    last = parsed.groupBy("dex", "margin_table").agg(F.max_by("t.marginTiers", "time").alias("raw"))
    w = W.partitionBy("dex", "margin_table").orderBy("lowerBound")
    rate = F.lit(0.5) / F.col("maxLeverage")
    steps = last.select("dex", "margin_table", F.inline("raw")).withColumn("step", rate - F.coalesce(F.lag(rate).over(w), F.lit(0.0)))
    return steps.groupBy("dex", "margin_table").agg(F.array_sort(F.collect_list(F.struct(F.col("lowerBound").cast("double").alias("from"), "step"))).alias("tiers"))


def maintenance(notional: Column, tiers: Column) -> Column:
    """Maintenance margin of a position: each tier's rate on the part of the notional within it."""
    return F.aggregate(tiers, F.lit(0.0), lambda sum_, t: sum_ + F.greatest(notional.cast("double") - t["from"], F.lit(0.0)) * t["step"])


def funding_regime(spark: SparkSession, path: str) -> DataFrame:
    """(coin, day, rate, hours): the sum of a day's rates and how many there are; a repeated hour counts once."""
    rates = read(spark, path, "funding_history").dropDuplicates(["coin", "time"])
    return rates.groupBy("coin", F.to_date(F.timestamp_millis("time")).alias("day")).agg(F.sum("fundingRate").cast("double").alias("rate"), F.count("*").alias("hours"))


def funding_payments(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, coin, usdc, szi, rate); pages overlap, so a payment of an address, coin and moment counts once."""
    rows = read(spark, path, "user_funding").select(address(F.col("user")).alias("address"), "time", "delta.coin", "delta.usdc", "delta.szi", F.col("delta.fundingRate").cast("double").alias("rate"))
    return rows.dropDuplicates(["address", "coin", "time"])


def request_load(spark: SparkSession, path: str) -> DataFrame:
    """(address, requests, cap, volume) of the newest answer."""
    rows = read(spark, path, "rate_limit").select(address(F.col("user")).alias("address"), F.struct("time", "nRequestsUsed", "nRequestsCap", "cumVlm").alias("r"))
    return rows.groupBy("address").agg(F.max("r").alias("r")).select("address", F.col("r.nRequestsUsed").alias("requests"), F.col("r.nRequestsCap").alias("cap"), F.col("r.cumVlm").alias("volume"))


def vault_equities(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, vault, equity), kept apart from the account's own."""
    rows = read(spark, path, "vault_equities").select(address(F.col("user")).alias("address"), "time", F.inline("equities"))
    return rows.select("address", "time", address(F.col("vaultAddress")).alias("vault"), "equity").dropDuplicates(["address", "time", "vault"])


def debts(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, token, borrowed, supplied): what is to be taken off an account's own equity."""
    side = f"struct<value: {MONEY}>"
    pair = read(spark, path, "borrows").select(address(F.col("user")).alias("address"), "time", F.explode("tokenToState").alias("p"))
    rows = pair.select("address", "time", F.get("p", F.lit(0)).alias("token"), F.from_json(F.get("p", F.lit(1)), f"struct<borrow: {side}, supply: {side}>").alias("s"))
    zero = F.lit(0).cast(MONEY)
    return rows.select("address", "time", "token", F.coalesce("s.borrow.value", zero).alias("borrowed"), F.coalesce("s.supply.value", zero).alias("supplied")).dropDuplicates(["address", "time", "token"])


def own_equity(margins: DataFrame, debts: DataFrame) -> DataFrame:
    """``margins`` with the debt known at that moment taken off: own_equity and the leverage on it (null where nothing is left)."""
    owed = debts.groupBy("address", "time").agg(F.sum("borrowed").alias("borrowed"))
    stacked = margins.select("address", "time", "equity", "notional", F.lit(None).cast(MONEY).alias("borrowed"), F.lit(1).alias("k")).unionByName(owed.select("address", "time", "borrowed", F.lit(0).alias("k")), allowMissingColumns=True)
    w = W.partitionBy("address").orderBy("time", "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = stacked.withColumn("debt", F.coalesce(F.last("borrowed", ignorenulls=True).over(w), F.lit(0))).filter("k = 1")
    own = F.col("equity") - F.col("debt")
    return known.select("address", "time", "equity", "debt", own.alias("own_equity"), F.when(own > 0, (F.col("notional") / own).cast("double")).alias("leverage"))


def twaps(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, coin, side, size, executed, notional, minutes, status): the last state of each order."""
    rows = read(spark, path, "twap_history").select(address(F.col("user")).alias("address"), F.inline("twaps"))
    return rows.select("address", "time", "state.coin", "state.side", F.col("state.sz").alias("size"), F.col("state.executedSz").alias("executed"), F.col("state.executedNtl").alias("notional"), "state.minutes", "status.status").distinct()


def chain_transfers(spark: SparkSession, path: str, token: str, decimals: int = 6) -> DataFrame:
    """Transfers of ``token`` from its event logs, each log once: src, dst, amount, block, hash. An amount of more than 64 bits is null."""
    hexed = lambda c: F.conv(F.substring(c, 3, 64), 16, 10)
    logs = read(spark, path, "transfer_logs").filter((address(F.col("address")) == token.lower()) & (F.lower(F.get("topics", F.lit(0))) == TRANSFER_TOPIC) & (F.size("topics") == 3))
    party = lambda k: F.concat(F.lit("0x"), F.right(address(F.get("topics", F.lit(k))), F.lit(40)))
    small = F.substring("data", 3, 48) == "0" * 48
    amount = F.when(small, F.conv(F.right("data", F.lit(16)), 16, 10).cast("decimal(38,0)") / F.lit(10**decimals))
    return logs.dropDuplicates(["transactionHash", "logIndex"]).select(party(1).alias("src"), party(2).alias("dst"), amount.cast(MONEY).alias("amount"), hexed(F.col("blockNumber")).cast("long").alias("block"), F.col("transactionHash").alias("hash"), hexed(F.col("logIndex")).cast("long").alias("log"))


def funders(transfers: DataFrame, ignore: DataFrame) -> DataFrame:
    """(address, funder): who sent an address its first transfer; senders in ``ignore.address`` (exchanges' hot wallets) are no link."""
    first = transfers.filter("src <> dst AND amount > 0").groupBy("dst").agg(F.min_by("src", F.struct("block", "log")).alias("funder"))
    return first.join(ignore.select(F.lower("address").alias("funder")).distinct(), "funder", "left_anti").select(F.col("dst").alias("address"), "funder")
