"""Column functions on fully qualified names: Type, Type#member, package.Type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner(fqn: Column) -> Column:
    """What stands before the first #."""
    return F.substring_index(fqn, "#", 1)


def member(fqn: Column) -> Column:
    return F.when(F.instr(fqn, "#") > 0, F.substring(fqn, F.instr(fqn, "#") + 1, F.length(fqn)))


def package(fqn: Column) -> Column:
    """The owner up to its last dot; null without a dot."""
    own = owner(fqn)
    return F.when(own.contains("."), F.left(own, F.length(own) - F.length(F.substring_index(own, ".", -1)) - 1))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def test_like(fqn: Column) -> Column:
    return simple_name(fqn).rlike("(Test|Tests|IT)$")


def signature_hash(signature: Column) -> Column:
    return F.left(F.sha2(signature, 256), F.lit(16))


def caller_label(source: Column, caller_member: Column) -> Column:
    return F.when(F.coalesce(caller_member, F.lit("")) != "", F.concat(source, F.lit("#"), caller_member)).otherwise(source)


def impact_level(score: Column) -> Column:
    return F.when(score >= 76, "CRITICAL").when(score >= 51, "HIGH").when(score >= 21, "MEDIUM").otherwise("LOW")


def drift_severity(violations: Column) -> Column:
    return F.when(violations >= 5, "CRITICAL").when(violations >= 1, "HIGH").otherwise("CLEAN")


def migration_effort(kind: Column, callers: Column, radius: Column, tests: Column, has_hint: Column) -> Column:
    points = (F.lit(10) + F.least(callers * 5, F.lit(40)) + F.least(radius * 2, F.lit(25)) + F.when(kind.isin("CLASS", "INTERFACE"), 15).otherwise(0)
              + F.when((tests == 0) & (callers > 0), 15).otherwise(0) - F.when(has_hint, 15).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(1), points)).cast("int")


def effort_category(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def normal_path(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, r"\{[^}]+\}", "{*}"), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def service_key(name: Column) -> Column:
    return F.translate(F.lower(name), "-_", "")


def markdown_safe(text: Column) -> Column:
    """Control characters to spaces, ` to ', | to /, <> to (), 200 characters."""
    return F.left(F.trim(F.translate(F.regexp_replace(text, r"\p{Cntrl}", " "), "`|<>", "'/()")), F.lit(200))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def placeholder_key(value: Column) -> Column:
    """key of ${key:default}."""
    return F.nullif(F.regexp_extract(value, r"\$\{([^:}]+)", 1), F.lit(""))


def java_hash(text: Column) -> Column:
    """The 32-bit hash 31 * h + c over the characters, as a signed long."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


# The supported majors in jdk_major().
def jdk_major(version: Column) -> Column:
    major = F.regexp_extract(version, r"(\d+)", 1)
    return F.when(major.isin("25", "21", "17", "11"), major).otherwise("UNKNOWN")


# The patterns in replacement_hint(), by which a note names what replaces a symbol.
def replacement_hint(annotations: Column, javadoc: Column) -> Column:
    """From the annotations in order, then from the javadoc."""
    def first(text, pattern):
        return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))

    per = F.transform(annotations, lambda a: F.coalesce(first(a, "replaceWith\\s*=\\s*ReplaceWith\\([\"']([^\"']+)[\"']\\)"), first(a, r"(?i)use\s+([a-zA-Z0-9_#.]+)\s+instead")))
    doc = F.regexp_replace(javadoc, r"\{@link\s+([^}]+)\}", "$1")
    quoted = "[`\"'{]*([a-zA-Z0-9_#.]+)[`\"'}]*"
    return F.coalesce(F.get(F.filter(per, lambda x: x.isNotNull()), F.lit(0)), first(doc, r"@see\s+([a-zA-Z0-9_#.]+)"),
                      first(doc, rf"(?i)@deprecated\s+replaced by\s+{quoted}"), first(doc, rf"(?i)@deprecated\s+use\s+{quoted}\s+instead"))
