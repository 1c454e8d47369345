"""Architecture rules: YAML files and presets, as the dictionaries that operators.analyse.rule_violations takes.

A rule has name, description, source and target (annotations, pattern), message and kinds. Kinds default to CALLS and USES.
"""

from __future__ import annotations

import re

KINDS = ("IMPORTS", "EXTENDS", "IMPLEMENTS", "USES", "CALLS", "TESTS")
DEFAULT_KINDS = ["CALLS", "USES"]

# Rules of each preset, as name, layers that must not depend, layers that they must not depend on. {p} is the base package.
PRESETS = {
    "hexagonal": [
        ("hexagonal-domain-isolation", r"{p}domain(\..*)?", r"{p}(application|adapter|adapters|infrastructure|infra)(\..*)?"),
        ("hexagonal-application-isolation", r"{p}application(\..*)?", r"{p}(adapter|adapters|infrastructure|infra)(\..*)?"),
        ("hexagonal-adapter-inbound-isolation", r"{p}adapter(s)?\.in(bound)?(\..*)?", r"{p}adapter(s)?\.out(bound)?(\..*)?"),
    ],
    "clean": [
        ("clean-entities-independence", r"{p}(entity|entities|domain)(\..*)?", r"{p}(usecase|usecases|controller|controllers|presenter|gateway|db|framework)(\..*)?"),
        ("clean-usecases-independence", r"{p}(usecase|usecases)(\..*)?", r"{p}(controller|controllers|presenter|ui|framework)(\..*)?"),
    ],
    "3-tier": [
        ("three-tier-repo-isolation", r"{p}(repository|repositories|repo|dao|persistence)(\..*)?", r"{p}(service|services|controller|controllers|web|api)(\..*)?"),
        ("three-tier-service-isolation", r"{p}(service|services)(\..*)?", r"{p}(controller|controllers|web|api)(\..*)?"),
        ("three-tier-controller-to-repo-bypass", r"{p}(controller|controllers|web|api)(\..*)?", r"{p}(repository|repositories|repo|dao|persistence)(\..*)?"),
    ],
}


class RuleError(ValueError):
    """A rules file that does not hold rules."""


def preset(name: str, base_package: str | None = None) -> list[dict]:
    """The preset's rules below base_package, or at any depth without one."""
    if name.lower() not in PRESETS:
        raise RuleError(f"no preset {name}; there are {', '.join(PRESETS)}")
    base = (base_package or "").rstrip(".")
    prefix = (base.replace(".", r"\.") + r"\." if base else "") + r"(.*\.)?"
    return [{"name": n, "description": None, "source": {"annotations": [], "pattern": a.replace("{p}", prefix)}, "target": {"annotations": [], "pattern": b.replace("{p}", prefix)},
             "message": None, "kinds": list(DEFAULT_KINDS)} for n, a, b in PRESETS[name.lower()]]


def parse_rules(text: str) -> list[dict]:
    """Rules of a YAML text with a top-level list ``rules``."""
    import yaml

    try:
        root = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from e
    found = root.get("rules") if isinstance(root, dict) else None
    if not isinstance(found, list):
        raise RuleError("a top-level list 'rules' is needed")
    return [_rule(i, r) for i, r in enumerate(found)]


def load_rules(spark, path: str) -> list[dict]:
    """Rules of a file in any file system that Spark reads; none if the file is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return parse_rules("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def find_rules(spark, *paths: str) -> list[dict]:
    """Rules of the first of the paths that has any."""
    return next((r for r in (load_rules(spark, p) for p in paths) if r), [])


def _rule(i: int, r) -> dict:
    if not isinstance(r, dict) or not r.get("name"):
        raise RuleError(f"rules[{i}] needs a name")

    def side(key):
        s = r.get(key)
        if not isinstance(s, dict):
            raise RuleError(f"rules[{i}] needs '{key}'")
        notes, pattern = s.get("annotations") or [], s.get("namePattern")
        try:
            re.compile(pattern or "")
        except re.error as e:
            raise RuleError(f"rules[{i}].{key}.namePattern: {e}") from e
        return {"annotations": [str(a) for a in notes], "pattern": pattern}

    kinds = [str(k).upper() for k in r.get("edgeKinds") or DEFAULT_KINDS]
    unknown = [k for k in kinds if k not in KINDS]
    if unknown:
        raise RuleError(f"rules[{i}].edgeKinds: no kind {unknown[0]}")
    return {"name": str(r["name"]), "description": r.get("description"), "source": side("from"), "target": side("to"), "message": r.get("message"), "kinds": kinds}


def to_yaml(rules: list[dict]) -> str:
    """YAML that parse_rules() reads back."""
    import yaml

    def side(s):
        return {k: v for k, v in (("namePattern", s.get("pattern")), ("annotations", s.get("annotations"))) if v}

    out = [{k: v for k, v in (("name", r["name"]), ("description", r.get("description")), ("from", side(r["source"])), ("to", side(r["target"])), ("message", r.get("message")), ("edgeKinds", list(r.get("kinds") or DEFAULT_KINDS))) if v is not None} for r in rules]
    return yaml.safe_dump({"rules": out}, sort_keys=False, width=1000)
