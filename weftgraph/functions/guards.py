"""Checks on paths, names and arguments, as plain functions for the driver and as columns."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that a watch never enters, and the files that it looks at.
IGNORED_FOLDERS = ("build", "target", "out", "node_modules", "dist", "bin")
WATCHED = ("java", "kt", "ts", "tsx", "js", "jsx", "py", "go", "yml", "yaml", "properties")


def resolve_under(root: str, candidate: str) -> str:
    """candidate below root, as a plain path; ValueError where it is absolute or leads out of root. Paths in a store have no links."""
    if candidate.startswith(("/", "\\")) or candidate[1:2] == ":" or "://" in candidate:
        raise ValueError(f"absolute path: {candidate}")
    root = posixpath.normpath(root) if "://" not in root else root.rstrip("/")
    inside = posixpath.normpath(candidate.replace("\\", "/"))
    if inside == ".." or inside.startswith("../"):
        raise ValueError(f"path leads out of its root: {candidate}")
    return root if inside == "." else f"{root}/{inside}"


def stays_inside(path: Column) -> Column:
    """Whether a relative path never climbs above its start: no absolute form, and no prefix with more .. than folders."""
    plain = F.translate(path, "\\", "/")
    depth = F.aggregate(
        F.filter(F.split(plain, "/"), lambda x: ~x.isin("", ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, x: F.struct(F.when(x == "..", s["at"] - 1).otherwise(s["at"] + 1).alias("at"), F.least(s["low"], F.when(x == "..", s["at"] - 1).otherwise(s["at"] + 1)).alias("low")),
        lambda s: s["low"])
    return ~plain.startswith("/") & ~plain.rlike("^[A-Za-z]:") & ~plain.contains("://") & (depth >= 0)


def safe_argument(text: Column) -> Column:
    """Neither empty nor with control characters."""
    return (F.length(text) > 0) & ~text.rlike("[\\x00-\\x1f\\x7f]")


def partition_name(module: Column) -> Column:
    """A module name as a folder name."""
    return F.translate(module, ":/\\", "___")


def kind_label(kind: Column) -> Column:
    return F.lower(kind)


def repo_slug(url: Column) -> Column:
    """owner/name of a hosted repository's address, null for other addresses."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.trim(url), r"\.git$", ""), r"github\.com[:/](.+)$", 1), F.lit(""))


def watched(path: Column) -> Column:
    """Whether a changed file matters: a watched extension, and no ignored or hidden folder above it."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda x: x.isin(*IGNORED_FOLDERS) | (x.startswith(".") & ~x.isin(".", "..")))
    return ~hidden & F.element_at(parts, -1).rlike(r"\.(" + "|".join(WATCHED) + ")$")


def commit_context(branch: str | None = None, commit: str | None = None, author: str | None = None, environment: dict | None = None) -> dict:
    """branch, commit and author as given, else from the environment of a build, else defaults. Nothing is run to find them."""
    env = environment or {}

    def first(given, *names, default):
        return given or next((env[n] for n in names if env.get(n)), default)

    return {
        "branch": first(branch, "GITHUB_REF_NAME", "CI_COMMIT_REF_NAME", "BRANCH_NAME", default="main"),
        "commit": first(commit, "GITHUB_SHA", "CI_COMMIT_SHA", "GIT_COMMIT", default="HEAD"),
        "author": first(author, "GITHUB_ACTOR", "GITLAB_USER_LOGIN", "GIT_AUTHOR_NAME", default="unknown"),
    }
