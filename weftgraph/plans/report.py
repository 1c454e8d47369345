"""The Markdown report of a graph in seven sections, renders of other results, and unified diffs of changed sources.

All counts, rankings and cuts are made in Spark; only rows that a section shows come to the driver, each list bounded.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators import analyse, traverse
from weftgraph.plans.emit import flow_diagram, module_diagram, package_diagram

# Stereotypes in the order in which they are listed.
STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Entity", "Component", "Configuration", "SpringBootApplication", "FeignClient"]
KINDS = ["IMPORTS", "EXTENDS", "IMPLEMENTS", "USES", "CALLS", "TESTS"]
MAX_PACKAGES, EXAMPLES, MAX_MODULES = 30, 5, 200


def safe(text) -> str:
    """Text that cannot leave its place in a Markdown line."""
    clean = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in str(text))
    return clean.translate(str.maketrans("`|<>", "'/()")).strip()[:200]


def _rows(df: DataFrame, n: int) -> list:
    return df.limit(n).collect()


def smells(edges: DataFrame, symbols: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(detector, title, evidence) of each detector that finds something, in fixed order."""
    out = []
    for name, found, text in (("god-class-fan-out", analyse.god_fan_out(edges), lambda r: f"{r['fqn']} ({r['calls']} calls)"), ("god-class-fan-in", analyse.god_fan_in(edges), lambda r: f"{r['fqn']} ({r['callers']} callers)"),
                              ("dead-code", analyse.dead_code(edges, symbols).orderBy("fqn"), lambda r: r["fqn"])):
        rows = _rows(found, 10)
        if rows:
            out.append((name, f"{len(rows)}{'+' if len(rows) == 10 else ''} found", [text(r) for r in rows]))
    pairs = traverse.package_pairs(edges.where("kind not in ('TESTS', 'IMPORTS')"))
    groups = traverse.strongly_connected(pairs)
    rows = _rows(groups.groupBy("component").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("node")), 1, 15), ", ").alias("packages")).orderBy(F.desc("n"), "component"), 10)
    if rows:
        out.append(("cyclic-packages", f"{len(rows)} groups", [r["packages"] for r in rows]))
    return out


def markdown(edges: DataFrame, symbols: DataFrame, name: str, version: str = "1") -> str:
    types = symbols.where("kind not in ('METHOD', 'FIELD')")
    modules = [r["module"] for r in _rows(symbols.select("module").distinct().orderBy("module"), MAX_MODULES)]
    counted = {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()}
    top = types.agg(F.count("*").alias("n"), F.count_if(ids.simple_name(F.col("qualified_name")).rlike("(Test|Tests)$")).alias("tests")).first()
    notes = {r["note"]: r["count"] for r in types.select(F.explode("annotations").alias("note")).where(F.col("note").isin(STEREOTYPES)).groupBy("note").count().collect()}
    overview = [f"- **Modules:** {len(modules)} ({', '.join(map(safe, modules))})", f"- **Top-level types:** {top['n']} (test-suffixed: {top['tests']})", "- **Edges by kind:** " + ", ".join(f"{k}={counted.get(k, 0)}" for k in KINDS)]

    links = [(r[0], r[1]) for r in _rows(traverse.module_dependencies(edges, symbols).orderBy("module", "target_module"), MAX_MODULES)]
    architecture = ["### Module diagram", "", module_diagram(modules, links), "", f"### Package dependencies (top {MAX_PACKAGES} by weight)", "", package_diagram(analyse.package_weights(edges, symbols), max_nodes=MAX_PACKAGES), "",
                    "**Detected stereotypes:** " + (", ".join(f"{s}×{notes.get(s, 0)}" for s in STEREOTYPES) if notes else "none detected")]
    paths = [r["participants"].split(" -> ") for r in analyse.flows(edges, symbols).collect()]
    flows = [x for p in paths for x in (f"#### {safe(p[0])}", "", flow_diagram(p), "", "Participants: " + " -> ".join(map(safe, p)), "")][:-1]
    hot = analyse.hotspots(edges, symbols).collect()
    table = ["| Symbol | Score | Level | Callers | Tests affected |", "|---|---|---|---|---|", *[f"| {safe(r['root'])} | {r['score']} | {r['level']} | {r['transitive_callers']} | {r['affected_tests']} |" for r in hot]] if hot else []

    better, bare = [], analyse.untested_public(edges, symbols)
    untested = bare.count()
    if untested:
        better.append(f"- **Untested public API:** {untested} public types have no TESTS edge. Examples: " + ", ".join(f"`{safe(r['fqn'])}`" for r in _rows(bare.orderBy("fqn"), EXAMPLES)))
    quality = analyse.resolution_quality(edges).first()
    if quality["possible"]:
        better.append(f"- **Resolution quality:** {quality['possible']}/{quality['calls']} CALLS edges are only possible.")
    better.append("- **Architecture rules:** state rules in a rules file; what breaks them raises impact scores.")
    found = [x for d, title, evidence in smells(edges, symbols) for x in (f"**{d}** - {title}", *[f"  - {safe(e)}" for e in evidence], "")][:-1]
    appendix = [f"- Engine version: {version}", f"- Symbols in index: {symbols.count()}", f"- Edges in index: {sum(counted.values())}"]
    parts = [("1. Overview", overview), ("2. Architecture", architecture), ("3. Key Flows", flows or ["_No entry-point flows detected._"]), ("4. Hotspots", table or ["_No hotspot candidates._"]), ("5. Points of Improvement", better),
             ("6. Code Smells & Risk Findings", found or ["_No findings._"]), ("7. Appendix", appendix)]
    return "\n".join([f"# Analysis: {safe(name)}", "", *[x for title, lines in parts for x in (f"## {title}", *lines, "")]]).rstrip() + "\n"


def table(rows: DataFrame, title: str, order: list, most: int = 100) -> str:
    """The first rows by order as a Markdown table, with the count of all: for deprecations, federation links and refactorings."""
    cut = rows.orderBy(*order).limit(most).collect()
    head = [f"# {safe(title)}", "", f"Rows: {rows.count()}", ""]
    return "\n".join([*head, "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *["| " + " | ".join(safe("" if v is None else v) for v in r) + " |" for r in cut], ""])


#: Lines that one side of a hunk has at most.
HUNK = 21


def _until(lines: list[str], at: int, mark: str | None) -> int:
    """Where the run from at ends: before the next line equal to mark (None: at the end), after HUNK lines at most."""
    stop = min(len(lines), at + HUNK)
    return next((k for k in range(at, stop) if lines[k] == mark), stop) if mark is not None else stop


def unified_diff(path: str, before: str, after: str) -> str:
    """A diff without context lines, found greedily: where the texts part, old lines go until the new text's next line turns up, then new
    lines come until the old text's next line does. Empty for equal texts."""
    if before == after:
        return ""
    old, new = (re.split(r"\r\n|\r|\n", text) for text in (before, after))
    at = path.replace("\\", "/")
    out, i, j = [f"--- a/{at}", f"+++ b/{at}"], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            i, j = i + 1, j + 1
            continue
        gone = _until(old, i, new[j] if j < len(new) else None)
        come = _until(new, j, old[gone] if gone < len(old) else None)
        out.append(f"@@ -{i + 1},{gone - i} +{j + 1},{come - j} @@")
        out += ["-" + line for line in old[i:gone]] + ["+" + line for line in new[j:come]]
        i, j = gone, come
    return "\n".join(out) + "\n"
