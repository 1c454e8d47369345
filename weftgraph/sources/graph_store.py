"""A code graph as tables in one folder, in versions, and its incremental update.

A write puts the rows of some modules into new files and then publishes a version that names, for each table and module, the batch
its rows are in. Nothing that a version names is changed or deleted by later writes, so a reader keeps the version that it began with, and a write
that is lost on its way leaves the version before it: its files are named by none. A version covers all tables a write touched, so a
module's symbols, edges and file states change together. Modules that a write doesn't name are neither read nor rewritten. vacuum() deletes
what the last versions don't name.

    <table>/batch=<id>/module=<module>/   rows, by the write that made them; modules is one table, under the module ALL
    _manifests/<id>/                      (table, module, batch) of a version, as a table
    _versions/<number>-<id>               an empty file, made last: the version is there once it is

Writers are one at a time: of two that publish the same number one fails. A table that was never written is empty.

facts, exports and names keep what parsers read, what modules show to others and which names they looked at (operators.linking), so
that update() parses changed files only and links those modules anew whose edges may differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import linking, lookup, store
from weftgraph.plans.scratch import stored
from weftgraph.sources.parsers import FACTS

_KINDS = dict(f.split() for f in FACTS.split(", "))
SCHEMAS = {
    "symbols": "kind string, name string, qualified_name string, parent_fqn string, file_path string, line_start int, line_end int, visibility string, annotations array<string>, signature_hash string, synthetic boolean, module string",
    "edges": "source_fqn string, target_fqn string, kind string, confidence string, file_path string, line int, caller_member string, module string",
    "unresolved": "symbol string, file_path string, line int, reason string, module string",
    "file_state": "path string, hash string, indexed_at timestamp, module string",
    "embeddings": "symbol_fqn string, kind string, summary_text string, embedding array<float>, dimensions int, updated_at timestamp, module string",
    "modules": "name string, path string, build_system string",
    "facts": FACTS,
    "exports": ", ".join(f"{c} {_KINDS[c]}" for c in linking.EXPORT),
    "names": "module string, name string",
}
BY_MODULE = tuple(t for t in SCHEMAS if t != "modules")
#: The one module of a table that is not by module.
ALL = "*"
MANIFEST = "table string, module string, batch string"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions
    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, name: str) -> list[str]:
        fs, where = self._file(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[str]:
        """Published versions, oldest first."""
        return [v for v in self._listed("_versions") if not v.startswith((".", "_"))]

    def manifest(self, version: str | None = None) -> DataFrame:
        """(table, module, batch) of a version, by default the last."""
        known = [version] if version else self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/{known[-1].split('-', 1)[1]}")

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table as a version has it, by default the last one."""
        schema, live = SCHEMAS[table], self.manifest(version).where(F.col("table") == table).select("module", "batch")
        fs, where = self._file(table)
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        names = [f.split(" ", 1)[0] for f in schema.split(", ")]
        whole = schema if "module" in names else schema + ", module string"
        rows = self.spark.read.schema(whole + ", batch string").parquet(f"{self.path}/{table}")
        return rows.join(live, ["module", "batch"], "left_semi").select(*names)

    def _rows(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns in its order and types; those that are lacking are null."""
        fields = [f.split(" ", 1) for f in SCHEMAS[table].split(", ")]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])

    def _put(self, table: str, rows: DataFrame, batch: str) -> None:
        """Writes rows as a batch that no version names yet. A module's rows lie together, in several files where they are many."""
        rows = self._rows(table, rows)
        if table == "modules":
            rows = rows.withColumn("module", F.lit(ALL))
        rows.hint("rebalance", "module").withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "module").parquet(f"{self.path}/{table}")

    def _publish(self, before: list[str], changes: DataFrame, batch: str) -> None:
        """changes: table, module, batch (null: gone). The version becomes visible with its last step."""
        kept = self.manifest(before[-1] if before else None).join(changes.select("table", "module"), ["table", "module"], "left_anti")
        kept.unionByName(changes.where("batch is not null")).select("table", "module", "batch").coalesce(1).write.parquet(f"{self.path}/_manifests/{batch}")
        number = int(before[-1].split("-")[0]) + 1 if before else 1
        fs, where = self._file(f"_versions/{number:08d}-{batch}")
        fs.create(where, False).close()
        if [v for v in self.versions() if v.startswith(f"{number:08d}-")][0] != where.getName():
            fs.delete(where, False)
            raise RuntimeError("another writer published a version at the same time")

    def commit(self, parts: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """parts: for each table (modules that it replaces, their new rows); all at once. The modules are a table with the column module;
        one without rows is left with none. Rows of other modules are not written."""
        before, batch, changes = self.versions(), uuid.uuid4().hex, None
        for table, (modules, rows) in parts.items():
            modules = modules.select("module").distinct()
            if table != "modules":
                rows = self._rows(table, rows).join(modules, "module", "left_semi").select(*self._rows(table, rows).columns)
            self._put(table, rows, batch)
            written = self.spark.read.schema("module string, batch string").parquet(f"{self.path}/{table}").where(F.col("batch") == batch).select("module").distinct()
            named = modules.join(written.withColumn("batch", F.lit(batch)), "module", "left").select(F.lit(table).alias("table"), "module", "batch")
            changes = named if changes is None else changes.unionByName(named)
        self._publish(before, changes, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes batches and manifests that none of the last keep versions names, such as those of writes that were lost, and their
        older versions; says how many folders went. Not while another writer is at work."""
        kept, live = self.versions()[-max(1, keep):], set()
        for v in kept:
            # a row a write
            live |= {r["batch"] for r in self.manifest(v).select("batch").distinct().collect()}
        old = [f"{t}/{b}" for t in SCHEMAS for b in self._listed(t) if b.startswith("batch=") and b[len("batch="):] not in live]
        old += [f"_versions/{v}" for v in self.versions() if v not in kept]
        old += [f"_manifests/{m}" for m in self._listed("_manifests") if m not in {v.split("-", 1)[1] for v in kept}]
        for name in old:
            fs, where = self._file(name)
            fs.delete(where, True)
        return len(old)

    # writes
    def _modules(self, names) -> DataFrame:
        return self.spark.createDataFrame([(m,) for m in names], "module string")

    def initialise(self) -> None:
        """Publishes an empty first version if there is none."""
        if not self.versions():
            self._publish([], self.spark.createDataFrame([], MANIFEST), uuid.uuid4().hex)

    def migrate(self, legacy_edges: DataFrame) -> int:
        """Takes over edges of an older layout (columns may be lacking: member and path empty, line 0) unless there are edges."""
        if not self.read("edges").isEmpty():
            return 0
        rows = self._rows("edges", legacy_edges).fillna({"caller_member": "", "file_path": "", "line": 0, "confidence": "POSSIBLE"})
        rows = stored(store.keep_last(rows, store.EDGE_KEY, [F.col("confidence"), F.col("file_path")]), "migrated")
        self.commit({"edges": (rows, rows)})
        return rows.count()

    def replaced(self, modules: DataFrame, symbols: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> tuple[dict, dict[str, int]]:
        """(parts of a commit that replaces modules' symbols, edges and unresolved names, how many symbols and edges come in)."""
        symbols = stored(self._rows("symbols", symbols).join(modules, "module", "left_semi"), "new-symbols")
        edges = stored(self._rows("edges", edges).join(modules, "module", "left_semi").fillna({"caller_member": "", "file_path": ""}), "new-edges")
        unique = store.keep_last(edges, store.EDGE_KEY, [F.col("confidence"), F.col("file_path")])
        parts = {"symbols": (modules, symbols), "edges": (modules, unique)}
        if unresolved is not None:
            parts["unresolved"] = (modules, unresolved)
        return parts, {"symbols": symbols.count(), "edges": edges.count()}

    def replace(self, modules: list[str], symbols: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> dict[str, int]:
        """Replaces modules' symbols, edges and unresolved names; returns how many symbols and edges came in. A module without new
        rows is left without any."""
        parts, counts = self.replaced(self._modules(modules), symbols, edges, unresolved)
        self.commit(parts)
        return counts

    def upsert_edges(self, rows: DataFrame) -> None:
        """The last of equal keys wins; only the modules that rows touch are rewritten."""
        rows = stored(self._rows("edges", rows), "upsert-edges")
        touched = rows.select("module").distinct()
        old = self.read("edges").join(touched, "module", "left_semi").select(*rows.columns)
        self.commit({"edges": (touched, store.upsert_edges(old, rows))})

    def upsert_embeddings(self, rows: DataFrame) -> None:
        """The last of a symbol wins, whatever module it was in; only modules that have or had one of the symbols are rewritten."""
        rows = stored(self._rows("embeddings", rows), "upsert-embeddings")
        old = self.read("embeddings")
        touched = stored(rows.select("module").unionByName(old.join(rows.select("symbol_fqn"), "symbol_fqn", "left_semi").select("module")).distinct(), "touched")
        old = old.join(touched, "module", "left_semi").select(*rows.columns).withColumn("_seq", F.lit(0))
        both = store.keep_last(old.unionByName(rows.withColumn("_seq", F.lit(1))), ["symbol_fqn"], [F.col("_seq"), F.col("updated_at")]).drop("_seq")
        self.commit({"embeddings": (touched, both)})

    def recorded(self, rows: DataFrame, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The part of a commit that records modules: name, path, build_system (null: UNKNOWN); by name the last wins. without: modules that go."""
        rows = self._rows("modules", rows).fillna({"build_system": "UNKNOWN"}).withColumn("_seq", F.lit(1))
        old = self.read("modules")
        if without is not None:
            old = old.join(without.withColumnRenamed("module", "name"), "name", "left_anti").select("name", "path", "build_system")
        return self._modules([ALL]), store.keep_last(old.withColumn("_seq", F.lit(0)).unionByName(rows), ["name"], [F.col("_seq")]).drop("_seq")

    def record_modules(self, rows: DataFrame) -> None:
        self.commit({"modules": self.recorded(rows)})

    def stated(self, modules: DataFrame, states: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
        """The part of a commit that sets file states; as set_file_states."""
        return modules, states.withColumn("indexed_at", F.current_timestamp() if now is None else now)

    def set_file_states(self, modules: list[str], states: DataFrame, now=None) -> None:
        """states: module, path, hash; replaces those of modules, with one time stamp (now: a column; default the clock)."""
        self.commit({"file_state": self.stated(self._modules(modules), states, now)})

    def delete_modules(self, modules: list[str]) -> None:
        """From every table but the embeddings."""
        gone = self._modules(modules)
        parts = {t: (gone, self.spark.createDataFrame([], SCHEMAS[t])) for t in BY_MODULE if t != "embeddings"}
        self.commit(parts | {"modules": self.recorded(self.spark.createDataFrame([], SCHEMAS["modules"]), gone)})

    # lookups
    def find(self, fqn: str) -> DataFrame:
        return lookup.by_fqn(self.read("symbols"), fqn)

    def callers(self, fqn: str) -> DataFrame:
        return lookup.caller_rows(self.read("edges"), fqn)

    def callees(self, fqn: str) -> DataFrame:
        return lookup.caller_rows(self.read("edges"), fqn, False)

    def unresolved(self, module: str | None = None) -> DataFrame:
        return lookup.unresolved_of(self.read("unresolved"), module)

    def embedding(self, fqn: str) -> DataFrame:
        return lookup.embedding_of(self.read("embeddings"), fqn)


def update(graph: GraphStore, files: DataFrame, parse: Callable[[DataFrame], DataFrame], modules: DataFrame | None = None, now=None) -> dict:
    """Brings a store up to the files that there are now, as one version, and says what it did; the store then equals one made afresh.

    files: module, path, root, is_test, content - all source files of all modules. Files whose hash the store does not know change
    their module; so does a lost file. Modules that are gone are deleted. Only changed files are parsed (parse: files to facts, as
    parsers.extract). Linked anew are the changed modules, those with an edge onto a name that a changed module's files have, and those that
    looked at a name whose meaning has changed (linking.affected_names), against the exports of all. parsed lists them. modules:
    name, path and build_system to record."""
    states = stored(files.select("module", F.regexp_replace("path", r"\\", "/").alias("path"), F.sha2("content", 256).alias("hash")), "file-states")
    before = stored(graph.read("file_state").select("module", "path", "hash"), "file-states-before")
    met = before.withColumnRenamed("hash", "was").join(states.withColumnRenamed("hash", "is"), ["module", "path"], "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    current = states.select("module").distinct()
    differ = stored(met.select("module", "path", status.alias("status")).where("status is not null"), "changes")
    changes = differ.join(current, "module", "left_semi")
    full, counts = before.isEmpty(), {"symbols": 0, "edges": 0}
    gone = stored(lookup.deleted_modules(before, current).select("module"), "gone-modules")
    changed = stored(changes.select("module").distinct(), "changed-modules")
    todo = changed
    if not differ.isEmpty():
        # facts and exports of the modules that changed or went: files that are as they were keep their facts
        fresh = files.withColumn("as_stored", F.regexp_replace("path", r"\\", "/")).join(changes.where("status <> 'deleted'").select("module", F.col("path").alias("as_stored")), ["module", "as_stored"], "left_semi").drop("as_stored")
        stays = graph.read("facts").join(changed, "module", "left_semi").withColumn("as_stored", F.regexp_replace("path", r"\\", "/"))
        stays = stays.join(differ.select("module", F.col("path").alias("as_stored")), ["module", "as_stored"], "left_anti")
        facts = stored(graph._rows("facts", parse(fresh)).unionByName(graph._rows("facts", stays)), "facts")
        exports = stored(linking.exports(facts), "exports")
        touched = changed.unionByName(gone)
        others = graph.read("exports").join(touched, "module", "left_anti").select(*linking.EXPORT)
        index = stored(others.unionByName(exports), "index")
        if not full:
            was = stored(graph.read("exports").join(touched, "module", "left_semi").select(*linking.EXPORT), "exports-before")
            names = linking.affected_names(was, exports, index)
            looked = graph.read("names").join(names, "name", "left_semi").select("module").distinct()
            base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
            own = states.join(changed, "module", "left_semi").select(base.alias("name")).distinct()
            hit = store.invalidated_modules(graph.read("edges"), changed, own)
            todo = stored(changed.unionByName(hit.unionByName(looked).join(current, "module", "left_semi")).distinct(), "todo")
            kept = graph.read("facts").join(todo, "module", "left_semi").join(changed, "module", "left_anti")
            facts = stored(facts.unionByName(graph._rows("facts", kept)), "facts-to-link")
        made = linking.linked(facts, index)
        parts, counts = graph.replaced(todo.unionByName(gone), linking.symbols_of(facts), made["edges"], made["unresolved"])
        parts |= {"names": (todo.unionByName(gone), made["names"]), "facts": (touched, facts), "exports": (touched, exports), "file_state": graph.stated(touched, states, now)}
        new = graph.spark.createDataFrame([], SCHEMAS["modules"]) if modules is None else modules
        graph.commit(parts | {"modules": graph.recorded(new, gone)})
    elif modules is not None:
        graph.record_modules(modules)
    tally = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    # module names: as many as the source tree has
    listed = lambda rows: sorted(r["module"] for r in rows.collect())
    parsed = listed(todo)
    return {**{k: tally.get(k, 0) for k in ("added", "modified", "deleted")}, "parsed": parsed, "skipped": current.count() - len(parsed), "removed": listed(gone), "full": full, **counts}
