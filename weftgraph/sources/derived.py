"""A dependency graph over the star-schema tables: edges and symbols as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_COLUMNS = ["source_fqn", "target_fqn", "kind", "confidence", "module", "line", "caller_member"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores: rows of a table that has fewer splits than the cluster has cores are dealt out; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores, *keys)


def _name(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _edge(df, source, target, kind, confidence, module, line=0, caller=""):
    as_col = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    return df.select(source.alias("source_fqn"), target.alias("target_fqn"), F.lit(kind).alias("kind"), as_col(confidence).alias("confidence"), F.lit(module).alias("module"), as_col(line).cast("int").alias("line"), as_col(caller).alias("caller_member"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    line = spread(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag"), "l_orderkey", "l_linenumber")
    parts = t("part")
    n_parts = parts.count()
    order, part, customer, nation, supplier = (lambda k, p=p: _name(p, k) for p in ("sales.order.O", "catalog.part.P", "sales.customer.C", "geo.nation.N", "catalog.supplier.S"))
    return (
        _edge(t("nation"), nation("n_nationkey"), _name("geo.region.R", "n_regionkey"), "CALLS", "CONFIRMED", "geo")
        .unionByName(_edge(t("supplier"), supplier("s_suppkey"), nation("s_nationkey"), "CALLS", "CONFIRMED", "catalog"))
        .unionByName(_edge(t("customer"), customer("c_custkey"), nation("c_nationkey"), "USES", "CONFIRMED", "sales"))
        .unionByName(_edge(t("orders"), order("o_orderkey"), customer("o_custkey"), "USES", "POSSIBLE", "sales"))
        .unionByName(_edge(line, order("l_orderkey"), F.concat(part("l_partkey"), F.lit("#m"), F.col("l_linenumber").cast("string")), "CALLS",
                           F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("POSSIBLE"), "sales", F.col("l_linenumber"), F.col("l_returnflag")))
        .unionByName(_edge(line.where("l_linenumber = 1").select("l_partkey", "l_suppkey").distinct(), part("l_partkey"), supplier("l_suppkey"), "CALLS", "CONFIRMED", "catalog"))
        .unionByName(_edge(parts, part("p_partkey"), part((F.col("p_partkey") * 7 + 3) % n_parts), "EXTENDS", "CONFIRMED", "catalog"))
        .unionByName(_edge(t("events").where("event_type = 'purchase'").select("user_id").distinct(), F.concat(_name("test.user.U", "user_id"), F.lit("Test")), customer("user_id"), "TESTS", "CONFIRMED", "test")))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One type symbol per region, nation, supplier, customer and part."""
    def of(df, module, kind_name, letter, key, name, annotation=None):
        fqn = _name(f"{module}.{kind_name}.{letter}", key)
        visibility = F.element_at(F.array(*[F.lit(v) for v in ("PUBLIC", "PROTECTED", "PRIVATE", "PACKAGE")]), (F.col(key) % 4 + 1).cast("int"))
        notes = F.array().cast("array<string>") if annotation is None else F.when(annotation.isNotNull(), F.array(annotation)).otherwise(F.array().cast("array<string>"))
        return df.select(F.lit(module).alias("module"), F.when(F.col(key) % 5 == 0, "INTERFACE").otherwise("CLASS").alias("kind"), F.col(name).alias("name"), fqn.alias("qualified_name"),
                         F.concat(F.lit(f"{module}/{kind_name}"), (F.col(key) % 10).cast("string"), F.lit(".java")).alias("file_path"),
                         (F.col(key) % 50 * 10).cast("int").alias("line_start"), (F.col(key) % 50 * 10 + 8).cast("int").alias("line_end"), visibility.alias("visibility"), notes.alias("annotations"))

    t = lambda n: table(spark, sf_dir, n)
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "Controller").when(F.col("c_mktsegment") == "MACHINERY", "Repository")
    part_note = F.when(F.col("p_type") == "PROMO", "Deprecated").when(F.col("p_type") == "ECONOMY", "Entity")
    return (of(t("region"), "geo", "region", "R", "r_regionkey", "r_name", F.lit("Configuration")).unionByName(of(t("nation"), "geo", "nation", "N", "n_nationkey", "n_name"))
            .unionByName(of(t("supplier"), "catalog", "supplier", "S", "s_suppkey", "s_name")).unionByName(of(t("customer"), "sales", "customer", "C", "c_custkey", "c_name", segment))
            .unionByName(of(t("part"), "catalog", "part", "P", "p_partkey", "p_name", part_note)))


def _visibility(key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in ("PUBLIC", "PROTECTED", "PRIVATE", "PACKAGE")]), (key % 4 + 1).cast("int"))


def _method(df, module, owner, file, key, number, prefix, arguments):
    """Method symbols; owner and file: columns of the type that has them."""
    name = F.concat(F.lit(prefix), number.cast("string"))
    return df.select(
        F.lit(module).alias("module"), F.lit("METHOD").alias("kind"), name.alias("name"),
        F.concat(owner, F.lit("#"), name, F.lit(arguments)).alias("qualified_name"), owner.alias("parent_fqn"), file.alias("file_path"),
        (key % 50 * 10 + number).cast("int").alias("line_start"), _visibility(key + number).alias("visibility")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method symbols: one a part and line number of lineitem, one a customer and last digit of an order in base seven."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, customer = F.col("l_partkey"), F.col("o_custkey")
    file = lambda kind, key: F.concat(F.lit(kind), (key % 10).cast("string"), F.lit(".java"))
    of_parts = _method(line, "catalog", _name("catalog.part.P", part), file("catalog/part", part), part, F.col("l_linenumber").cast("long"), "m", "(int)")
    return of_parts.unionByName(_method(orders, "sales", _name("sales.customer.C", customer), file("sales/customer", customer), customer, F.col("o_orderkey") % 7, "o", "()"))


def order_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type symbol per order, with the columns of symbols()."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit("sales").alias("module"), F.lit("CLASS").alias("kind"), _name("O", key).alias("name"), _name("sales.order.O", key).alias("qualified_name"),
        F.concat(F.lit("sales/order"), (key % 10).cast("string"), F.lit(".java")).alias("file_path"),
        (key % 50 * 10).cast("int").alias("line_start"), (key % 50 * 10 + 8).cast("int").alias("line_end"), _visibility(key).alias("visibility"),
        F.array().cast("array<string>").alias("annotations"))
