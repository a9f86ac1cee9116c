"""The 35 detectors over members and cluster books in one pass, with penalties and evidence, and what follows from them.

Every base table is keyed by an *entity*: an address, or a cluster of linked addresses (a negative number). A member's row stands once under its own
entity and once under its cluster's, so each detector's text judges members and cluster books together. Detectors that speak of an address' relation to others
(``LIFTED``) are judged for members, and a cluster takes the worst of its members' results. A member fails when its cluster does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrade.operators.graph import connected_components
from tapegrade.plans import books, equity, links, rotation, screens, tape, trading
from tapegrade.plans.dialect import SMALL, Frames, oracle
from tapegrade.views import VIEWS as BASE

_TEXTS = trading.QUERIES | equity.QUERIES | tape.QUERIES | screens.QUERIES | links.QUERIES


@dataclass(frozen=True)
class Detector:
    """``text`` selects address and severity; ``evidence`` names the kind of fact that shows it; ``lifted`` ones are judged for members only."""

    code: str
    text: str
    evidence: str
    lifted: bool = False


def _of(key: str) -> str:
    return f"SELECT address, severity FROM ({_TEXTS[key]}) x"


REGISTRY = (
    Detector("D-M1", _of("d_m1"), "flow"), Detector("D-M2", _of("d_m2"), "rescue"), Detector("D-M3", _of("d_m3"), "state"), Detector("D-M4", _of("d_m4"), "state"), Detector("D-M5", _of("d_m5"), "rescue"),
    Detector("D-M6", _of("d_m6"), "flow"), Detector("D-M7", "SELECT address, severity FROM {rotations}", "flow", True), Detector("D-M8", _of("d_m8"), "flow"),
    Detector("D-H1", f"SELECT r.address, h.severity FROM {{registry}} r JOIN ({_TEXTS['d_h1_hedge']}) h ON coalesce(r.cluster, r.address) = h.cluster", "state"), Detector("D-H2", _of("d_h2_style"), "state"),
    Detector("D-H3", _of("d_h3_wash"), "fill", True), Detector("D-H4", _of("d_h4"), "flow", True), Detector("D-H5", _of("d_h5"), "fill", True), Detector("D-H6", _of("d_h6_carry"), "state"),
    Detector("D-R1", _of("d_r1_martingale"), "loss"), Detector("D-R2", _of("d_r2"), "loss"), Detector("D-R3", _of("d_r3"), "loss"), Detector("D-R4", _of("d_r4"), "liquidation"), Detector("D-R5", _of("d_r5"), "state"),
    Detector("D-R6", _of("d_r6_tilt"), "loss"), Detector("D-R7", _of("d_r7_edges"), "loss"),
    Detector("D-C1", _of("d_c1"), "win"), Detector("D-C2", _of("d_c2"), "win"), Detector("D-C3", _of("d_c3_impact"), "win"), Detector("D-C4", _of("d_c4"), "fill"), Detector("D-C5", _of("d_c5"), "flow"),
    Detector("D-C6", _of("d_c6"), "flow"), Detector("D-C7", _of("d_c7"), "win"), Detector("D-C8", _of("d_c8"), "win"),
    Detector("D-B1", _of("d_b1"), "fill"), Detector("D-B2", f"SELECT address, CASE WHEN category = 'ADT' THEN 'INFO' ELSE 'PASS' END AS severity FROM ({_TEXTS['d_b2']}) x", "fill", True), Detector("D-B3", _of("d_b3"), "fill", True),
    Detector("D-B4", "SELECT address, severity FROM {copiers}", "fill", True), Detector("D-B5", _of("d_b5"), "fill", True), Detector("D-B6", _of("d_b6"), "fill"),
)

_RANK = "CASE severity WHEN 'VETO' THEN 3 WHEN 'FLAG' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"


def members_only(text: str) -> str:
    """``text`` over the tables of members."""
    return re.sub(r"\{(fills|flows|registry|actions)\}", r"{member_\1}", text)


#: Views of the market and of links, which have no entities.
_SHARED = {k: members_only(text) for k, text in (BASE | links.VIEWS).items() if k in ("marks", "last_day", "all_transfers", "transfers", "link_edges", "cluster_of")}

#: All views, with tables keyed by entity.
ENTITY_VIEWS = BASE | equity.VIEWS | tape.VIEWS | trading.VIEWS | screens.VIEWS | links.VIEWS | rotation.VIEWS | _SHARED | {
    "copiers": members_only(links.PLANS["d_b4_copier"][1]),
    **{f"member_{k}": BASE[k] for k in ("fills", "flows", "registry", "actions")},
    "entity_of": "SELECT address, address AS entity FROM {member_registry} UNION ALL SELECT c.address, -1 - c.root FROM {cluster_of} c JOIN {member_registry} r ON c.address = r.address",
    "fills": "SELECT e.entity AS address, f.coin, f.day, f.month, f.ok, f.ln, f.sk, f.pk, f.sz, f.dq, f.notional_u, f.px_u, f.fee_u, f.pnl_u, f.crossed, f.flag FROM {member_fills} f JOIN {entity_of} e ON f.address = e.address",
    "flows": "SELECT e.entity AS address, f.id, f.day, f.month, f.kind, f.usdc_u, f.flow_u, f.priority FROM {member_flows} f JOIN {entity_of} e ON f.address = e.address",
    # a cluster starts with its members' capital together; it names the cluster of each member, and none of its own
    "registry": """
        SELECT r.address, r.name, r.funder, r.slot, r.value_u, r.role, coalesce(-1 - c.root, -1000000000 - r.address) AS cluster FROM {member_registry} r LEFT JOIN {cluster_of} c ON r.address = c.address
        UNION ALL SELECT e.entity, max(r.name), max(r.funder), 0, SUMI(r.value_u + 1000000000000) - 1000000000000, 'user', NULL FROM {entity_of} e JOIN {member_registry} r ON e.address = r.address WHERE e.entity < 0 GROUP BY e.entity""",
    "rotations": members_only(rotation.VIEWS["rotations"]), "drains": members_only(rotation.VIEWS["drains"]), "starts": members_only(rotation.VIEWS["starts"]), "chains": members_only(rotation.VIEWS["chains"]), "chain_books": members_only(rotation.VIEWS["chain_books"]),
}


def _rows(d: Detector) -> str:
    if not d.lifted:
        return f"SELECT address AS entity, '{d.code}' AS code, severity FROM ({d.text}) d"
    worst = f"SELECT e.entity, max({_RANK}) AS k FROM ({members_only(d.text)}) d JOIN {{entity_of}} e ON d.address = e.address GROUP BY e.entity"
    return f"SELECT entity, '{d.code}' AS code, CASE k WHEN 3 THEN 'VETO' WHEN 2 THEN 'FLAG' WHEN 1 THEN 'INFO' ELSE 'PASS' END AS severity FROM ({worst}) w"


_UNION = " UNION ALL ".join(_rows(d) for d in REGISTRY)

#: kind -> (entity, day, ref, amount) of the facts that may show a result
_FACTS = {
    "flow": "SELECT address, day, id AS ref, usdc_u AS amount FROM {flows} WHERE kind <> 'withdraw'",
    "rescue": "SELECT address, day, id, usdc_u FROM {rescues}",
    "loss": "SELECT address, close_day, trip, -net_u FROM {closed_trips} WHERE net_u < 0",
    "win": "SELECT address, close_day, trip, net_u FROM {closed_trips} WHERE net_u > 0",
    "fill": "SELECT address, day, ok, notional_u FROM {fills}",
    "liquidation": "SELECT address, day, ok, notional_u FROM {fills} WHERE flag = 'R' AND ln = 1 AND ok % 40 = 0",
    "state": "SELECT address, day, day, exposure_u FROM (SELECT address, day, SUMI(exposure_u) AS exposure_u FROM {states} GROUP BY address, day) s",
}
_KINDS = " UNION ALL ".join(f"SELECT '{code}' AS code, '{kind}' AS kind" for code, kind in ((d.code, d.evidence) for d in REGISTRY))
#: The largest facts of each entity and kind, as day:ref:amount; ranks are limited before the shuffle, so no entity's facts are gathered.
_EVIDENCE = f"""
    SELECT address AS entity, kind, concat_ws(';', max(CASE WHEN k = 1 THEN item END), max(CASE WHEN k = 2 THEN item END), max(CASE WHEN k = 3 THEN item END)) AS evidence FROM (
      SELECT address, kind, k, concat_ws(':', CAST(day AS STRING), CAST(ref AS STRING), CAST(amount AS STRING)) AS item FROM (
        SELECT *, row_number() OVER (PARTITION BY address, kind ORDER BY amount DESC, day, ref) AS k FROM ({' UNION ALL '.join(f"SELECT '{kind}' AS kind, f.* FROM ({text}) f" for kind, text in _FACTS.items())}) a) r WHERE k <= $evidence) t GROUP BY address, kind"""



def _results(rows: str, evidence: str) -> str:
    return f"""
    SELECT r.entity, r.code, r.severity, CASE WHEN r.severity = 'FLAG' THEN $flag_penalty ELSE 0 END AS penalty, CASE WHEN r.severity <> 'PASS' THEN e.evidence END AS evidence
    FROM ({rows}) r JOIN ({_KINDS}) c ON r.code = c.code LEFT JOIN ({evidence}) e ON r.entity = e.entity AND c.kind = e.kind"""


#: The results by kind of evidence, and the evidence: each is written by a query of its own, so that no query waits for the tables of all 35 detectors at once.
PARTS = {f"found_{kind}": " UNION ALL ".join(_rows(d) for d in REGISTRY if d.evidence == kind) for kind in _FACTS} | {"evidence": _EVIDENCE}
_JOINED = _results(" UNION ALL ".join(f"SELECT entity, code, severity FROM {{{name}}}" for name in PARTS if name != "evidence"), "SELECT entity, kind, evidence FROM {evidence}")

VIEWS = {
    "results": oracle(_results(_UNION, _EVIDENCE), ENTITY_VIEWS),
    # what the results say of an address: its own and its cluster's; leverage lowered in a loss counts to the tally of rescues
    "verdicts": """
        SELECT a.address, coalesce(o.vetoes, 0) AS vetoes, coalesce(c.vetoes, 0) AS cluster_vetoes, coalesce(o.families, 0) AS families, coalesce(o.penalty, 0) AS penalty, coalesce(o.vetoes, 0) + coalesce(c.vetoes, 0) > 0 AS vetoed
        FROM {registry} a LEFT JOIN {entity_verdicts} o ON a.address = o.entity LEFT JOIN {cluster_of} m ON a.address = m.address LEFT JOIN {entity_verdicts} c ON -1 - m.root = c.entity""",
    "entity_verdicts": """
        SELECT entity, SUMI(vetoes) + max(CASE WHEN tally >= 2 THEN 1 ELSE 0 END) AS vetoes, SUMI(CASE WHEN flags > 0 THEN 1 ELSE 0 END) AS families, SUMI(least($family_cap, penalty)) AS penalty FROM (
          SELECT entity, family, vetoes, flags, penalty, CAST(sum(rescues) OVER (PARTITION BY entity) AS BIGINT) AS tally FROM (
            SELECT entity, substr(code, 1, 3) AS family, SUMI(CASE WHEN severity = 'VETO' THEN 1 ELSE 0 END) AS vetoes, SUMI(CASE WHEN severity = 'FLAG' THEN 1 ELSE 0 END) AS flags, SUMI(penalty) AS penalty,
              SUMI(CASE WHEN code IN ('D-M2', 'D-M4', 'D-M5') AND severity = 'FLAG' THEN 1 ELSE 0 END) AS rescues FROM {results} GROUP BY entity, substr(code, 1, 3)) f) t GROUP BY entity""",
    "vetoed": "SELECT address, vetoed FROM {verdicts}",
}

QUERIES = {
    "detector_results": "SELECT entity, code, severity, penalty, evidence FROM {results}",
    "severity_policy": """
        SELECT address, vetoes, cluster_vetoes, families, penalty, CASE WHEN vetoed THEN 'vet_fail' WHEN families >= $qa_families THEN 'needs_qa' ELSE 'clean' END AS verdict FROM {verdicts}""",
    "qa_sample": "SELECT address, verdict FROM (SELECT address, 'VETO' AS verdict FROM {verdicts} WHERE vetoed) v ORDER BY (address * 7919 + 13) % 10007, address LIMIT 20",
}


def cluster_of(t: Frames) -> DataFrame:
    """Address and root (the smallest address reachable) over hard and transfer links."""
    return connected_components(t["link_edges"].select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))).select(F.col("node").alias("address"), "root")


#: Views that several detectors read; written once, in this order.
KEPT = ("cluster_of", ("fills", "flows", "registry", "marks"), ("trip_legs", "returns", "states", "board"))
#: The same, of what is made from these.
KEPT_THEN = (("closed_trips", "drawdowns", "leverage", "open_books", "day_stats"), ("rescues", "trip_stats"))
#: What the returns hold of the equity, so that nobody sums fills and flows for it again.
EQUITY = ("address", "day", "month", "net_u", "flow_u", "equity_u")
#: Of these, the ones whose rows of an address are the same for members alone.
OF_MEMBERS = ("fills", "flows", "trip_legs", "closed_trips", "returns", "drawdowns", "states", "leverage", "open_books", "rescues", "day_stats", "trip_stats", "board")


def entity_frames(t: Frames) -> Frames:
    """Frames over entities that start from the members' tables of ``t``."""
    built = {"cluster_of": cluster_of, "underwater_days": books.underwater_days, "copiers": lambda e: links.d_b4_copier(t), "chains": rotation.chains} | links.BUILT
    e = Frames(t.spark, t.sf_dir, ENTITY_VIEWS | PARTS, t.config, built)
    # tables that were given by hand, as in tests, are taken as they are
    e.made |= {f"member_{name}": t.made[name] for name in ("fills", "flows", "registry", "actions") if name in t.made}
    return e


def results(t: Frames) -> DataFrame:
    """(entity, code, severity, penalty, evidence) of all detectors, written once.

    Views of ``t`` that nobody has asked for yet are taken from the written tables, so what follows makes nothing again.
    """
    e = entity_frames(t).keep(*KEPT[:2]).send_market(SMALL).keep(*KEPT[2:])
    e.made["equity"] = e["returns"].select(*EQUITY)
    e.keep(*KEPT_THEN, *PARTS)
    found = e.written(_JOINED, "results")
    for name in OF_MEMBERS:
        t.made.setdefault(name, e[name].filter("address >= 0"))
    t.made.setdefault("equity", t["returns"].select(*EQUITY))
    t.small = e.small
    t.made.setdefault("marks", e["marks"])
    t.made.setdefault("cluster_of", e["cluster_of"])
    return found


BUILT = {"results": results, "cluster_of": cluster_of}
