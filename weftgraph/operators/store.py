"""Table maintenance: upserts, module replacement, file-state differences, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.ids import owner, simple_name

EDGE_KEY = ["source_fqn", "target_fqn", "kind", "caller_member", "line", "module"]


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; order must be total for a stable result."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_l"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in rows.columns])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """new over old on the edge key: the newer confidence wins."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    both = both.withColumn("caller_member", F.coalesce("caller_member", F.lit("")))
    return keep_last(both, EDGE_KEY, [F.col("_seq"), F.col("confidence")]).drop("_seq")


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, kind): confirmed first, then with a calling member, then the lowest line."""
    order = Window.partitionBy("source_fqn", "target_fqn", "kind").orderBy(F.when(F.col("confidence") == "CONFIRMED", 0).otherwise(1), F.when(F.coalesce("caller_member", F.lit("")) != "", 0).otherwise(1), "line", "caller_member", "module")
    return edges.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def replace_modules(path: str, rows: DataFrame) -> None:
    """Overwrites the module partitions that rows has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def delete_module(table: DataFrame, module: str) -> DataFrame:
    return table.where(F.col("module") != module)


def merge_stores(*tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    keys = keys or EDGE_KEY
    return keep_last(out, keys, [F.struct(*[c for c in out.columns if c not in keys])])


def file_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of added, modified and deleted files; before and after: path, hash."""
    met = before.withColumnRenamed("hash", "was").join(after.withColumnRenamed("hash", "now"), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return met.select("path", status.alias("status")).where("status is not null")


def invalidated_modules(edges: DataFrame, changed_modules: DataFrame, changed_names: DataFrame) -> DataFrame:
    """Modules, not changed themselves, with an edge whose target's simple name is one of changed_names (name)."""
    hit = edges.where("kind in ('IMPORTS', 'USES', 'CALLS', 'EXTENDS')").select("module", simple_name(owner(F.col("target_fqn"))).alias("name")).join(changed_names, "name", "left_semi")
    return hit.select("module").distinct().join(changed_modules, "module", "left_anti")


def page(rows: DataFrame, order: list[str], cursor: str | None, limit: int) -> tuple[DataFrame, str | None]:
    """A page at an offset cursor (not a number: 0) and the next cursor, null at the end."""
    offset = int(cursor) if cursor and cursor.isdigit() else 0
    got = rows.orderBy(*order).offset(offset).limit(limit)
    return got, str(offset + limit) if not rows.orderBy(*order).offset(offset + limit).isEmpty() else None


def confidence_report(edges: DataFrame, symbols: DataFrame, unresolved: DataFrame) -> DataFrame:
    one = edges.agg(F.count("*").alias("edges")).join(symbols.agg(F.count("*").alias("symbols"))).join(unresolved.agg(F.count("*").alias("unresolved")))
    total = F.col("symbols") + F.col("unresolved")
    return one.withColumn("rate", F.when(total == 0, 1.0).otherwise(F.floor(F.col("symbols") / total * 1000) / 1000))


def name_prefix(symbols: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """Case-insensitive prefix search; % and _ are wildcards, as in the pattern language it stands for."""
    return symbols.where(F.col("name").ilike(prefix + "%")).orderBy("qualified_name").limit(limit)


def by_file(symbols: DataFrame, file_path: str) -> DataFrame:
    """Symbols of a path, of paths that end with it, or with its bare file name; by line."""
    path = file_path.replace("\\", "/")
    bare = path.rsplit("/", 1)[-1]
    own = F.regexp_replace("file_path", r"\\", "/")
    return symbols.where((own == path) | own.endswith(path) | own.endswith(bare)).orderBy("line_start", "qualified_name")


def deprecated_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.exists("annotations", lambda a: a.ilike("%deprecated%")))
