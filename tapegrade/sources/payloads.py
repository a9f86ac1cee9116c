"""Endpoint payloads landed as JSON or CSV: explicit schemas, drift reports, and the readers of each shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(38,18)"
FILL = f"coin string, px {MONEY}, sz {MONEY}, side string, time long, startPosition {MONEY}, dir string, closedPnl {MONEY}, hash string, oid long, crossed boolean, fee {MONEY}, builderFee {MONEY}, tid long, twapId long"
FILL_STRUCT = "struct<" + ", ".join(": ".join(c.split(" ", 1)) for c in FILL.split(", ")) + ">"

#: Schema of one JSON line of each payload.
SCHEMAS = {
    "trades": f"coin string, side string, px {MONEY}, sz {MONEY}, time long, hash string, tid long, users array<string>",
    "user_fills": f"user string, {FILL}",
    "node_trades": f"coin string, side string, time long, px {MONEY}, sz {MONEY}, hash string, tid long, side_info array<struct<user: string, start_pos: {MONEY}, oid: long, twap_id: long>>",
    "node_fills": f"user string, fill {FILL_STRUCT}",
    "node_fills_by_block": f"block_number long, block_time long, events array<struct<user: string, fill: {FILL_STRUCT}>>",
    "leaderboard": f"ethAddress string, accountValue {MONEY}, windowPerformances array<struct<span: string, pnl: {MONEY}, roi: {MONEY}, vlm: {MONEY}>>",
    "ledger": f"user string, time long, hash string, delta struct<type: string, usdc: {MONEY}, amount: {MONEY}, usdcValue: {MONEY}, netWithdrawnUsd: {MONEY}, token: string, user: string, destination: string, vault: string, operation: string, toPerp: boolean, fee: {MONEY}, liquidatedNtlPos: {MONEY}, accountValue: {MONEY}, leverageType: string, liquidatedPositions: array<struct<coin: string, szi: {MONEY}>>>",
    "candles": f"coin string, interval string, t long, o {MONEY}, h {MONEY}, l {MONEY}, c {MONEY}, v {MONEY}",
}

#: How a ledger entry moves perp money: 1 in, -1 out, 0 not at all or by its fields; income is never trading result.
LEDGER_SIGN = {"deposit": 1, "withdraw": -1, "internalTransfer": 0, "subAccountTransfer": 0, "send": 0, "spotTransfer": 0, "accountClassTransfer": 0, "vaultWithdraw": 1, "vaultDeposit": -1, "vaultCreate": -1, "borrowLend": 0}
#: Entries between two addresses: in for the destination, out for the sender, nothing within one address.
LEDGER_BETWEEN = ("internalTransfer", "subAccountTransfer", "send", "spotTransfer")
LEDGER_BORROW = {"borrow": 1, "withdraw": 1, "repay": -1, "supply": -1}
#: Entries that move no money of the account's: events, costs of deployment, settings.
LEDGER_EVENTS = ("liquidation", "spotGenesis", "deployGasAuction", "activateDexAbstraction")
LEDGER_INCOME = ("rewardsClaim", "vaultLeaderCommission", "vaultDistribution", "cStakingTransfer")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """Lines of a landed payload; a line that does not parse is kept in ``_corrupt_record``."""
    return spark.read.schema(schema(name).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def drift(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Top-level fields of the lines that the schema lacks, with counts: the alarm for changed endpoints."""
    known = [f.name for f in schema(name).fields]
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.filter(~F.col("field").isin(known)).groupBy("field").agg(F.count("*").alias("n"))


def address(column: Column) -> Column:
    """Addresses are compared in lower case."""
    return F.lower(column)


def fills(spark: SparkSession, node_trades: str | list[str] | None = None, node_fills: str | list[str] | None = None, by_block: str | list[str] | None = None, paged: str | list[str] | None = None) -> DataFrame:
    """One fill table of the three archive shapes and of pages asked for by wallet (the endpoint's or an indexer's); columns that a shape lacks are null.

    One row a (address, tid): of several the one from the page, else the block, the fill, the trade file, in this order.
    """
    parts = []
    if node_trades:
        t = read(spark, node_trades, "node_trades").select("*", F.posexplode("side_info").alias("k", "s"))
        side = F.when(F.col("k") == 0, "B").otherwise("A")
        parts.append(t.select(address(F.col("s.user")).alias("address"), "coin", "px", "sz", side.alias("side"), F.col("s.start_pos").alias("startPosition"), "time", "hash", "tid", F.col("s.oid").alias("oid"), F.col("s.twap_id").alias("twapId")))
    if node_fills:
        parts.append(read(spark, node_fills, "node_fills").select(address(F.col("user")).alias("address"), "fill.*"))
    if by_block:
        parts.append(read(spark, by_block, "node_fills_by_block").select(F.explode("events").alias("e")).select(address(F.col("e.user")).alias("address"), "e.fill.*"))
    if paged:
        parts.append(read(spark, paged, "user_fills").withColumn("address", address(F.col("user"))).drop("user", "_corrupt_record"))
    parts = [p.withColumn("_from", F.lit(k)) for k, p in enumerate(parts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    found = out.groupBy("address", "tid").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("address", "tid", "_from")]), "_from").alias("f"))
    return found.select("address", "tid", "f.*")


#: Which shape the archive's folders hold, by the start of their name.
ARCHIVE_SHAPES = {"node_fills_by_block": "by_block", "node_fills": "node_fills", "node_trades": "node_trades"}


def archive_work(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, shape, day, turn) of archive files in ``paths.path`` by folder name and date; the newest day has the first turn. Others are left out."""
    shape = F.regexp_extract("path", "/(node_fills_by_block|node_fills|node_trades)(?:/|$)", 1)
    day = F.to_date(F.nullif(F.regexp_extract("path", r"/(\d{8})(?:/|\.|$)", 1), F.lit("")), "yyyyMMdd")
    work = paths.select("path", shape.alias("shape"), day.alias("day")).filter("shape <> '' AND day IS NOT NULL").distinct()
    days = work.select("day").distinct().select("day", F.rank().over(Window.orderBy(F.desc("day"))).alias("turn"))
    return work.join(days, "day").select("path", "shape", "day", "turn")


def archive_fills(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fills of archive folders, each read by the shape that its name tells."""
    by: dict[str, list[str]] = {}
    for path in paths:
        name = next((n for n in ARCHIVE_SHAPES if f"/{n}/" in f"{path}/"), None)
        if name is None:
            raise ValueError(f"no known archive shape in {path}")
        by.setdefault(ARCHIVE_SHAPES[name], []).append(path)
    return fills(spark, **by)


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """address, account_value, span, pnl, roi, vlm: a row a window."""
    return read(spark, path, "leaderboard").select(address(F.col("ethAddress")).alias("address"), F.col("accountValue").alias("account_value"), F.inline("windowPerformances")).withColumn("roi", F.col("roi").cast("double"))


def ledger_flows(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries with their signed external flow; income is flagged, not a flow, and a type that is not known here has a null flow."""
    d = F.col("delta")
    kind = d["type"]
    sign = F.when(kind.isin(*LEDGER_INCOME, *LEDGER_EVENTS), 0)
    for name, s in LEDGER_SIGN.items():
        sign = F.when(kind == name, s).otherwise(sign)
    borrowed = F.lit(None).cast("int")
    for name, s in LEDGER_BORROW.items():
        borrowed = F.when(d["operation"] == name, s).otherwise(borrowed)
    inside = F.coalesce(address(d["user"]) == address(d["destination"]), F.lit(False))
    between = F.when(inside, 0).when(address(d["destination"]) == address(F.col("user")), 1).otherwise(-1)
    moved = F.when(kind == "accountClassTransfer", F.when(d["toPerp"], 1).otherwise(-1)).when(kind == "borrowLend", borrowed).when(kind.isin(*LEDGER_BETWEEN), between).otherwise(sign)
    amount = F.when(moved == 0, F.lit(0)).otherwise(F.coalesce(d["netWithdrawnUsd"], d["usdcValue"], d["usdc"], d["amount"]))
    return read(spark, path, "ledger").select(address(F.col("user")).alias("address"), "time", "hash", kind.alias("type"), (moved * amount).alias("flow"), F.coalesce(kind.isin(*LEDGER_INCOME), F.lit(False)).alias("income"))


def ledger_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, type, n, usdc): who sent to whom, and deposits to and withdrawals from vaults; an entry that both sides' ledgers hold counts once."""
    d = F.col("delta")
    user, vault = address(F.col("user")), address(d["vault"])
    out, back = d["type"].isin("vaultCreate", "vaultDeposit"), d["type"] == "vaultWithdraw"
    src = F.when(d["type"].isin(*LEDGER_BETWEEN), F.coalesce(address(d["user"]), user)).when(out, user).when(back, vault)
    dst = F.when(d["type"].isin(*LEDGER_BETWEEN), address(d["destination"])).when(out, vault).when(back, user)
    rows = read(spark, path, "ledger").select(src.alias("src"), dst.alias("dst"), d["type"].alias("type"), "time", "hash", F.coalesce(d["netWithdrawnUsd"], d["usdcValue"], d["usdc"], d["amount"]).alias("usdc"))
    return rows.filter("src <> dst").distinct().groupBy("src", "dst", "type").agg(F.count("*").alias("n"), F.sum("usdc").alias("usdc"))


def liquidations(spark: SparkSession, path: str) -> DataFrame:
    """(address, time, hash, notional, account_value, leverage_type, coin, szi): a row a liquidated position."""
    d = F.col("delta")
    rows = read(spark, path, "ledger").filter(d["type"] == "liquidation")
    return rows.select(address(F.col("user")).alias("address"), "time", "hash", d["liquidatedNtlPos"].alias("notional"), d["accountValue"].alias("account_value"), d["leverageType"].alias("leverage_type"), F.inline_outer(d["liquidatedPositions"])).distinct()


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses named anywhere in text or CSV files."""
    found = F.regexp_extract_all("value", F.lit("(0x[a-fA-F0-9]{40})(?![a-fA-F0-9])"), F.lit(1))
    return spark.read.text(path).select(F.explode(found).alias("a")).select(address(F.col("a")).alias("address")).distinct()


def write_tape(trades: DataFrame, path: str) -> None:
    """Trades partitioned by date, clustered by coin: few files a day, prunable by date, skippable by coin."""
    day = F.to_date(F.timestamp_millis("time"))
    trades.withColumn("date", day).repartitionByRange("date", "coin").sortWithinPartitions("date", "coin", "time", "tid").write.mode("append").partitionBy("date").option("compression", "zstd").parquet(path)
