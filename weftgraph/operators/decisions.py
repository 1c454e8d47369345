"""Architecture decisions that a graph already follows, or breaks: counted in Spark, one record for each pattern found.

Five patterns: presentation against persistence, domain against infrastructure, packages without cycles, internal packages,
and one-way package flows (the first two by weight). A record has id, title, status (Accepted where nothing breaks it, else
Proposed; always Proposed for internal packages), counts and the rule that keeps it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators import analyse, traverse
from weftgraph.sources.rules import DEFAULT_KINDS, to_yaml

# What makes a type of each layer, by full name or annotation, and the layers in a rule's pattern.
WEB, WEB_NOTES = "(?i).*(Controller|Endpoint|Resource|Handler|Web|Api).*", ("Controller", "Endpoint")
STORE, STORE_NOTES = "(?i).*(Repository|Dao|Mapper|Store).*", ("Repository", "Dao")
DOMAIN, INFRA = r"(?i).*\.(domain|model|entity)(\..*)?", r"(?i).*\.(infrastructure|infra|adapters?|persistence|database|db|web)(\..*)?"
WEB_RULE, STORE_RULE = "(Controller|Endpoint|Resource|Web|Api).*", "(Repository|Dao|Mapper|Store).*"
DOMAIN_RULE, INFRA_RULE = r"(domain|model|entity)(\..*)?", r"(infrastructure|infra|adapters?|persistence|database|db|web)(\..*)?"
INNER = (".internal.", ".impl.")


def _record(title, rule, source, target, found, facts, accepted=None) -> dict:
    own = {"name": rule, "description": None, "source": {"pattern": source}, "target": {"pattern": target}, "message": None, "kinds": list(DEFAULT_KINDS)}
    return {"title": title, "status": "Accepted" if (found == 0 if accepted is None else accepted) else "Proposed", "violations": found, "facts": facts, "rule": own}


def mine(edges: DataFrame, symbols: DataFrame, base_package: str | None = None) -> list[dict]:
    types = symbols.where("kind not in ('METHOD', 'FIELD')").select(F.col("qualified_name").alias("fqn"), F.coalesce("annotations", F.array().cast("array<string>")).alias("notes")).distinct()
    if base_package is None:
        row = analyse.base_package(symbols).first()
        base_package = row[0] if row else None
    base = re.sub(r"\.", r"\\.", base_package) if base_package else None
    out = []

    def layer(pattern, notes=()):
        fits = F.col("fqn").rlike(f"^(?:{pattern})$")
        for n in notes:
            fits = fits | F.array_join("notes", "\n").contains(n)
        return types.where(fits).select("fqn")

    def pair(title, rule, a, b, source, target):
        n, m = a.count(), b.count()
        if n and m:
            out.append(_record(title, rule, source, target, analyse.couplings(edges, a, b).count(), {"from": n, "to": m}))

    lead = rf"{base}\..*" if base else ".*"
    pair("Web code reaches storage through services only", "no-presentation-to-persistence", layer(WEB, WEB_NOTES), layer(STORE, STORE_NOTES), lead + WEB_RULE, lead + STORE_RULE)
    lead = rf"{base}\." if base else r".*\."
    pair("The domain knows nothing of its adapters", "domain-must-not-depend-on-infrastructure", layer(DOMAIN), layer(INFRA), lead + DOMAIN_RULE, lead + INFRA_RULE)

    pairs = traverse.package_pairs(edges)
    packages = pairs.select(F.explode(F.array("src", "dst")).alias("p")).distinct().count()
    if packages > 1:
        cycles = traverse.strongly_connected(pairs).select(F.col("component")).distinct().count()
        out.append(_record("Packages form no rings", "prohibit-package-cycles", ".*", ".*", cycles, {"packages": packages}))
    inner = types.where(F.col("fqn").contains(INNER[0]) | F.col("fqn").contains(INNER[1])).count()
    if inner:
        out.append(_record("Internal packages stay internal", "no-cross-package-internal-access", ".*", lead + r".*\.(internal|impl)\..*", 0, {"types": inner}, accepted=False))
    for r in analyse.one_way_packages(edges).orderBy(F.desc("weight"), "src", "dst").limit(2).collect():
        a, b = (x.rsplit(".", 1)[-1] for x in (r["src"], r["dst"]))
        out.append(_record(f"{a} may use {b}, not the other way round", f"unidirectional-{a}-to-{b}", re.sub(r"\.", r"\\.", r["dst"]) + r"(\..*)?", re.sub(r"\.", r"\\.", r["src"]) + r"(\..*)?", 0, {"edges": r["weight"]}))
    return [{"id": f"ADR-{i:04d}", **r} for i, r in enumerate(out, 1)]


def file_name(record: dict) -> str:
    return f"{record['id'].lower()}-{re.sub('[^a-z0-9]+', '-', record['title'].lower()).strip('-')}.md"


def to_markdown(record: dict, date: str) -> str:
    """The record as a document; date is given, so that equal graphs give equal texts."""
    facts = ", ".join(f"{k}: {v}" for k, v in record["facts"].items())
    return "\n".join([f"# {record['id']}: {record['title']}", "", f"- **Status**: {record['status']}", f"- **Date**: {date}", "", "## Context", f"Counted in the graph: {facts}. Edges against the rule: {record['violations']}.", "",
                      "## Decision", f"The rule `{record['rule']['name']}` holds for all code.", "", "## Architecture rule", "```yaml", to_yaml([record["rule"]]).rstrip(), "```", ""])
