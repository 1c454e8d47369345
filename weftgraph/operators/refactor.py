"""Changes to Java sources as text: private methods that go, calls renamed, packages and imports rewritten; with diffs.

plan() runs over (path, content) rows, a file at a time; only files that change are returned. Comments and strings stay as
they are. A step is a dictionary: {"do": "remove", "method"}, {"do": "rename", "from", "to"} (all calls of that bare name),
{"do": "package", "to"} or {"do": "import", "from", "to"}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.report import unified_diff
from weftgraph.sources.parsers import Source

CHANGES = "path string, changes int, text string, diff string"


def apply(text: str, steps: list[dict]) -> tuple[str, int]:
    """The changed text and the number of places changed."""
    total = 0
    for s in steps:
        src = Source(text)
        if s["do"] == "remove":
            spans = []
            for m in re.finditer(rf"\bprivate\b[^;{{}}()=]*\b{re.escape(s['method'])}\s*\(", src.bare):
                body = re.compile(r"[^;{}]*\{").match(src.bare, src.end_of(m.end() - 1))
                if body:
                    end = src.close[body.end() - 1] + 1
                    spans.append((src.head_before(m.start()), end))
            for a, b in reversed(spans):
                text = text[:a] + text[b:]
            total += len(spans)
            continue
        if s["do"] == "rename":
            spans = [m.span(1) for m in re.finditer(rf"(?<!\w)({re.escape(s['from'])})\s*\(", src.bare) if not re.search(r"[\w>\]]\s+$", src.bare[:m.start()]) or re.search(r"\b(return|throw|else|case|assert)\s+$", src.bare[:m.start()])]
        elif s["do"] == "package":
            spans = [m.span(1) for m in re.finditer(r"^\s*package\s+([\w.]+)\s*;", src.bare, re.M)][:1]
        elif s["do"] == "import":
            spans = [m.span(1) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)", src.bare, re.M) if m.group(1) == s["from"]]
        else:
            raise ValueError(f"no step {s['do']}")
        for a, b in reversed(spans):
            text = text[:a] + s["to"] + text[b:]
        total += len(spans)
    return text, total


def plan(files: DataFrame, steps: list[dict]) -> DataFrame:
    """path, changes, text and diff of each file that the steps change."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in b.columns)):
                before = bytes(content or b"").decode("utf-8", "replace")
                after, n = apply(before, steps)
                if n and after != before:
                    rows.append((path, n, after, unified_diff(path, before, after)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "changes", "text", "diff"])

    return files.select("path", "content").mapInArrow(run, CHANGES)


def summary(changes: DataFrame) -> DataFrame:
    """files and changes over all."""
    return changes.agg(F.count("*").alias("files"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"))
