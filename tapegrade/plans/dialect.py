"""One text for Spark SQL and for the SQL that checks it: views, macros and thresholds.

A query names views in braces, thresholds with a dollar sign, and writes the few functions that differ
between the engines as macros in capitals. Money is kept in whole millionths (columns ``*_u``), so that sums
are exact and running sums come back to zero.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrade.config import DEFAULT, Config
from tapegrade.operators.graph import shared_folder

#: Views of the market: a row a coin and day at most, however many addresses trade.
MARKET = frozenset(("marks", "mark_blocks", "daily_marks", "market", "volumes"))
#: Rows up to which views of the market are sent to every executor.
SMALL = 1_000_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: macro -> (Spark, oracle); $1, $2 are its arguments
MACROS = {
    "DAYNUM": ("unix_date(CAST($1 AS DATE))", "date_diff('day', DATE '1970-01-01', CAST($1 AS DATE))"),
    "MONTHNUM": ("(year($1) * 12 + month($1) - 1)", "(year($1) * 12 + month($1) - 1)"),
    "DAYDATE": ("date_add(DATE '1970-01-01', CAST($1 AS INT))", "(DATE '1970-01-01' + CAST($1 AS INT))"),
    "MONTHDATE": ("make_date(CAST(floor(($1) / 12) AS INT), CAST(($1) % 12 + 1 AS INT), 1)", "make_date(CAST(floor(($1) / 12) AS BIGINT), CAST(($1) % 12 + 1 AS BIGINT), 1)"),
    "MS": ("unix_millis(CAST($1 AS TIMESTAMP))", "(epoch_us($1) // 1000)"),
    "DIV": ("(($1) div ($2))", "(($1) // ($2))"),
    "PCTL": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "SEQ": ("explode(sequence($1, $2))", "unnest(range($1, ($2) + 1))"),
    "FOUND": ("explode(regexp_extract_all($1, $2, 1))", "unnest(regexp_extract_all($1, $2, 1))"),
    "SUMI": ("sum($1)", "CAST(sum($1) AS BIGINT)"),
    # sums and products of whole numbers that may exceed 64 bits, which the oracle's own sums hold
    "WIDESUM": ("CAST(sum(CAST($1 AS DECIMAL(38,0))) AS DOUBLE)", "sum($1)"),
    "WIDE": ("(CAST($1 AS DECIMAL(19,0)) * CAST($2 AS DECIMAL(19,0)))", "$1 * $2"),
    "JOINED": ("listagg($1, ',') WITHIN GROUP (ORDER BY $1)", "string_agg($1, ',' ORDER BY $1)"),
    "DOW": ("weekday($1)", "(isodow($1) - 1)"),
    "CORR": ("(covar_pop($1, $2) / nullif(stddev_pop($1) * stddev_pop($2), 0))",) * 2,
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at ``at``, and where it ends."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"unclosed call in {text[at:at + 60]}")


_CALL = re.compile(r"\b(" + "|".join(MACROS) + r")\(")


def translate(sql: str, oracle: bool, config: Config = DEFAULT) -> str:
    """``sql`` with thresholds filled in and macros written out."""
    sql = re.sub(r"\$([a-z]\w*)", lambda m: config.literals()[m[1]], sql)
    while m := _CALL.search(sql):
        args, end = _arguments(sql, m.end() - 1)
        body = MACROS[m[1]][oracle]
        for k, a in enumerate(args, 1):
            body = body.replace(f"${k}", a)
        sql = sql[: m.start()] + body + sql[end:]
    # decimal literals are doubles in both engines
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Frames:
    """The views of one folder of tables, as DataFrames made when first asked for.

    ``built`` holds views that have a plan of their own instead of a text; the oracle takes their text all the same.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, views: dict[str, str], config: Config = DEFAULT, built: dict[str, Callable[[Frames], DataFrame]] | None = None):
        self.spark, self.sf_dir, self.views, self.config, self.built = spark, sf_dir, views, config, built or {}
        self.made: dict[str, DataFrame] = {}
        #: Views that joins may send to every executor, as their size has been seen to be small.
        self.small: frozenset[str] = frozenset()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in self.built:
                self.made[name] = self.built[name](self)
            else:
                self.made[name] = self.sql(self.views[name]) if name in self.views else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in self.small:
                self.made[name] = F.broadcast(self.made[name])
        return self.made[name]

    def keep(self, *names: str | tuple[str, ...]) -> Frames:
        """Writes views to the shared folder, in order, so that whatever is asked for afterwards reads them instead of making them again; those of a tuple at once."""
        folder = f"{shared_folder(self.spark)}/frames-{uuid.uuid4().hex}"

        def write(name: str) -> None:
            self.made[name].write.parquet(f"{folder}/{name}")

        for level in names:
            level = (level,) if isinstance(level, str) else level
            for name in level:
                self[name]  # noqa: B018
            with ThreadPoolExecutor(len(level)) as pool:
                list(pool.map(write, level))
            for name in level:
                self.made[name] = self.spark.read.parquet(f"{folder}/{name}")
        return self

    def store(self, key: str, *names: str, rows_each: int = 1_000_000) -> Frames:
        """Writes views to the shared folder in buckets of ``key``, so that whatever groups, orders or joins them by it, or by it and more columns, shuffles nothing.

        Joins by more columns than the key find both sides in place only if the planner need not spread them by all of these; this is set for the session.
        """
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self["lineitem"].count() // rows_each))
        folder = f"{shared_folder(self.spark)}/frames-{uuid.uuid4().hex}"
        for name in names:
            table = f"frames_{uuid.uuid4().hex}"
            self[name].repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{folder}/{name}").format("parquet").saveAsTable(table)
            self.made[name] = self.spark.table(table)
            self.spark.sql(f"DROP TABLE {table}")  # its files stay, and the frame knows them
        return self

    def send_market(self, rows: int) -> Frames:
        """Lets joins send the views of the market to every executor, if its coins times its days are at most so many; ``marks`` is written already."""
        coins, days = self["marks"].agg(F.countDistinct("coin"), F.coalesce(F.max("day") - F.min("day") + 1, F.lit(0))).first()
        if coins * days <= rows:
            self.small = MARKET
            self.made["marks"] = F.broadcast(self.made["marks"])
        return self

    def written(self, text: str, name: str) -> DataFrame:
        """The result of ``text``, written to the shared folder and read again."""
        self.made[name] = self.sql(text)
        return self.keep(name)[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(translate(text, False, self.config), **{n: self[n] for n in names(text)})


def oracle(text: str, views: dict[str, str], config: Config = DEFAULT) -> str:
    """The oracle's SQL: the views that ``text`` needs as common table expressions, in order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for n in names(sql):
            if n in views and n not in order:
                need(views[n])
                order.append(n)

    need(text)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", translate(s, True, config))
    ctes = [f"{n} AS ({plain(views[n])})" for n in order]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + f"SELECT * FROM ({plain(text)}) AS result"
