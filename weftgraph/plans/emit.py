"""Diagrams and alert payloads made from DataFrames: ranking, pruning and counting in Spark, text from bounded rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Violations that a payload spells out.
SHOWN = 8


class _Ids:
    def __init__(self):
        self.known: dict[str, str] = {}

    def of(self, name: str) -> str:
        return self.known.setdefault(name, f"n{len(self.known)}_" + re.sub("[^A-Za-z0-9]", "_", name)[:60])


def _label(name: str) -> str:
    return name.translate(str.maketrans('"[]', "'()"))


def _diagram(direction: str, lines: list[str]) -> str:
    return "\n".join(["```mermaid", f"graph {direction}", *("    " + x for x in lines), "```"])


def module_diagram(modules: list[str], links: list[tuple[str, str]]) -> str:
    ids = _Ids()
    return _diagram("TD", [f'{ids.of(m)}["{_label(m)}"]' for m in modules] + [f"{ids.of(a)} --> {ids.of(b)}" for a, b in links])


def package_diagram(weights: DataFrame, least: int = 2, max_nodes: int = 30, notes: dict[str, str] | None = None) -> str:
    """Diagram of src, dst, weight rows: light and inner links go, the max_nodes heaviest packages stay (ties by name)."""
    kept = weights.where((F.col("weight") >= least) & (F.col("src") != F.col("dst")))
    ends = kept.select(F.explode(F.array("src", "dst")).alias("package"), "weight")
    ranked = [r["package"] for r in ends.groupBy("package").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "package").limit(max_nodes + 1).collect()]
    nodes, ids = ranked[:max_nodes], _Ids()
    lines = [f'{ids.of(p)}["{f"{p}<br/>{notes[p]}" if notes and p in notes else _label(p)}"]' for p in nodes]
    if nodes:
        # at most max_nodes squared rows
        for r in kept.where(F.col("src").isin(nodes) & F.col("dst").isin(nodes)).orderBy(F.desc("weight"), "src", "dst").collect():
            lines.append(f'{ids.of(r["src"])} -->|"{r["weight"]}"| {ids.of(r["dst"])}')
    if len(ranked) > max_nodes:
        lines.append(f'{ids.of("<capped>")}[/"... capped at {max_nodes} packages by dependency weight ..."/]')
    return _diagram("LR", lines)


def flow_diagram(path: list[str], dashed_from: int | None = None) -> str:
    """A call path; participants first met at dashed_from or later are dashed."""
    ids, dashed = _Ids(), len(path) if dashed_from is None else dashed_from
    lines = [f'{ids.of(p)}["{_label(p.rsplit(".", 1)[-1])}"]' + (":::dashed" if path.index(p) >= dashed else "") for p in dict.fromkeys(path)]
    lines += [f"{ids.of(a)} --> {ids.of(b)}" for a, b in zip(path, path[1:]) if a != b]
    if len(path) > dashed:
        lines.append("classDef dashed stroke-dasharray: 5 5;")
    return _diagram("LR", lines)


def provider(url: Column) -> Column:
    """SLACK, TEAMS, DISCORD or GENERIC by a webhook's address."""
    low = F.lower(url)
    return (F.when(low.contains("hooks.slack.com"), "SLACK").when(low.contains("office.com") | low.contains("logic.azure.com"), "TEAMS")
            .when(low.contains("discord.com/api/webhooks") | low.contains("discordapp.com/api/webhooks"), "DISCORD").otherwise("GENERIC"))


def payloads(alerts: DataFrame, product: str = "Architecture check") -> DataFrame:
    """repo_name, provider, severity, n_violations and payload (JSON) of each alert; nothing is sent.

    alerts: repo_name, commit_sha, branch, author, at (timestamp), url, violations (array of struct with rule, source_fqn,
    target_fqn, edge_kind, line, message). Null violations: none. A payload spells the first eight out; GENERIC has all."""
    none = F.expr("array()").cast(alerts.schema["violations"].dataType)
    v = F.coalesce("violations", none)
    n, repo = F.size(v), F.col("repo_name")
    severity = F.when(n >= 5, "CRITICAL").when(n >= 1, "HIGH").otherwise("CLEAN")
    commit, when = F.coalesce(F.substring("commit_sha", 1, 7), F.lit("HEAD")), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bad, first = n > 0, F.slice(v, 1, SHOWN)

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def source(x):
        return F.concat(x["source_fqn"], F.when(x["line"] > 0, F.concat(F.lit(":"), x["line"].cast("string"))).otherwise(""))

    def listing(make, sep):
        """The first violations, one a line, and how many there are beyond them."""
        rest = F.when(n > SHOWN, text(sep, n - SHOWN, " not listed")).otherwise("")
        return F.concat(F.array_join(F.transform(first, make), sep), rest)

    def plain(x):
        why = F.when(x["message"].isNull(), "").otherwise(F.concat(F.lit(" ("), x["message"], F.lit(")")))
        return text(x["edge_kind"], " ", source(x), " -> ", x["target_fqn"], " breaks ", x["rule"], why)

    def field(key, value, name="name", said="value", **extra):
        more = [F.lit(v).alias(k) for k, v in extra.items()]
        return F.struct(F.lit(key).alias(name), value.alias(said), *more)

    branch, by = F.coalesce("branch", F.lit("default branch")), F.coalesce("author", F.lit("unknown author"))
    headline = F.when(bad, text(product, ": ", n, " broken rule(s) in ", repo)).otherwise(text(product, ": no broken rule in ", repo))
    whence = text(branch, ", ", commit, ", ", by, ", ", when)
    detail = F.when(bad, listing(plain, "\n")).otherwise("Nothing to list.")

    def block(kind, said=None, style="mrkdwn", elements=None):
        said = F.lit(None) if said is None else F.struct(F.lit(style).alias("type"), said.alias("text"))
        elements = F.lit(None) if elements is None else elements
        return F.struct(F.lit(kind).alias("type"), said.alias("text"), elements.alias("elements")).cast(
            "struct<type string, text struct<type string, text string>, elements array<struct<type string, text string>>>")

    small = F.array(F.struct(F.lit("plain_text").alias("type"), text("severity ", severity, ", ", whence).alias("text")))
    blocks = F.array(block("section", headline, "plain_text"), block("context", elements=small), block("divider"), block("section", text("```", detail, "```")))
    slack = F.struct(headline.alias("text"), blocks.alias("blocks"))
    facts = F.array(field("rules broken", n.cast("string")), field("severity", severity), field("seen at", when))
    section = F.struct(headline.alias("activityTitle"), whence.alias("activitySubtitle"), F.regexp_replace(detail, "\n", "  \n").alias("text"), facts.alias("facts"))
    teams = F.struct(F.lit("MessageCard").alias("@type"), F.lit("https://schema.org/extensions").alias("@context"), headline.alias("summary"),
                     F.when(bad, "b03a2e").otherwise("1e8449").alias("themeColor"), F.array(section).alias("sections"))
    fields = F.array(field("severity", severity, inline=True), field("rules broken", n.cast("string"), inline=True), field("listing", detail, inline=False))
    embed = F.struct(headline.alias("title"), whence.alias("description"), F.when(bad, 0xB03A2E).otherwise(0x1E8449).alias("color"), fields.alias("fields"))
    discord = F.struct(F.array(embed).alias("embeds"))
    generic = F.struct(repo.alias("repoName"), F.col("commit_sha").alias("commitSha"), "branch", "author", F.transform(v, lambda x: F.struct(
        x["rule"].alias("rule"), x["source_fqn"].alias("sourceFqn"), x["target_fqn"].alias("targetFqn"), x["edge_kind"].alias("edgeKind"), x["line"].alias("line"), x["message"].alias("message"))).alias("violations"), F.unix_millis("at").alias("timestamp"))
    kind = provider(F.col("url"))
    body = F.when(kind == "SLACK", F.to_json(slack)).when(kind == "TEAMS", F.to_json(teams)).when(kind == "DISCORD", F.to_json(discord)).otherwise(F.to_json(generic))
    return alerts.select("repo_name", kind.alias("provider"), severity.alias("severity"), n.alias("n_violations"), body.alias("payload"))
