"""Configuration sources: flattened YAML, properties and JSON, and bindings of keys to symbols."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(value, prefix: str = "") -> list[tuple[str, str]]:
    """Nested maps to dotted keys, lists to key[i], scalars as text (null: empty)."""
    if isinstance(value, dict):
        keys = ((str(k).lower() if isinstance(k, bool) else str(k), v) for k, v in value.items())
        return [x for k, v in keys for x in flatten(v, f"{prefix}.{k}" if prefix else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flatten(v, f"{prefix}[{i}]")]
    if isinstance(value, bool):
        value = str(value).lower()
    return [(prefix, "" if value is None else str(value))]


_BLANK = " \t\f"
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    """\\t, \\n, \\r, \\f and \\uXXXX as the characters they stand for; a backslash before anything else goes. A \\u without four
    hexadecimal digits stays as it is written."""
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)|\\$", lambda m: chr(int(m[1][1:], 16)) if m[1] and len(m[1]) == 5 else m[0] if m[1] == "u" else _ESCAPES.get(m[1], m[1]) if m[1] else "", text, flags=re.S)


def parse_properties(text: str) -> list[tuple[str, str]]:
    """Lines of key and value, parted by =, : or blanks; # and ! open comments, an odd number of backslashes at a line's end
    joins the next line without its leading blanks. Of equal keys the last counts."""
    out, held = {}, None
    for line in [*re.split(r"\r\n|[\r\n]", text), None]:
        if line is not None:
            line = line.lstrip(_BLANK)
            if held is None and (not line or line[0] in "#!"):
                continue
            line = (held or "") + line
            if (len(line) - len(line.rstrip("\\"))) % 2:
                held = line[:-1]
                continue
        else:
            line = held
        held = None
        if line:
            key = re.match(r"(?:\\.|[^\\=: \t\f])*", line, re.S)[0]
            value = re.match(r"[ \t\f]*[=:]?[ \t\f]*(.*)", line[len(key):], re.S)[1]
            out[_unescaped(key)] = _unescaped(value)
    return list(out.items())


def parse_file(path: str, text: str) -> list[tuple[str, str]]:
    """By extension: yml and yaml, properties, else nothing. Files that don't parse give nothing."""
    if path.endswith((".yml", ".yaml")):
        import yaml

        try:
            docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
        except yaml.YAMLError:
            return []
        return list({k: v for d in docs for k, v in flatten(d)}.items())
    return parse_properties(text) if path.endswith(".properties") else []


def properties_of(files: DataFrame) -> DataFrame:
    """files: path, content (binary). (key, value, source_file) of application configuration files outside tests.

    For a key in several files the profile file wins over the base file, then the path in order."""
    named = files.where(F.col("path").rlike(r"/application(-[A-Za-z0-9_-]+)?\.(yml|yaml|properties)$") & ~F.col("path").contains("/src/test/"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, v, p) for p, c in zip(*(x.to_pylist() for x in b.columns)) for k, v in parse_file(p, c.decode("utf-8", "replace"))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["key", "value", "source_file"])

    rows = named.select("path", "content").mapInArrow(run, "key string, value string, source_file string")
    best = F.struct(F.when(F.col("source_file").rlike(r"/application-[^/]+$"), 0).otherwise(1), "source_file", "value")
    return rows.groupBy("key").agg(F.min(best).alias("b")).select("key", F.col("b.value").alias("value"), F.col("b.source_file").alias("source_file"))


def flatten_json(rows: DataFrame) -> DataFrame:
    """rows: prefix, json. (key, value) of every leaf."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [x for p, j in zip(*(c.to_pylist() for c in b.columns)) for x in flatten(json.loads(j), p)]
            cols = list(zip(*got)) or [()] * 2
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["key", "value"])

    return rows.select("prefix", "json").mapInArrow(run, "key string, value string")


def bindings_for(bindings: DataFrame, key: str) -> DataFrame:
    return bindings.where((F.col("property_key") == key) | F.col("property_key").startswith(key + "."))
