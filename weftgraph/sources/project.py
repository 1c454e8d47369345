"""What a project says about itself: its settings, its Java version, the configuration its types bind; exports and bundles.

Columns: see each function. Missing files give defaults; texts that don't parse give defaults too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_JDK = 21
# Supported majors, and where build files state the version, in order of precedence.
MAJORS = (25, 21, 17, 11)
JDK_PATTERNS = {
    "pom.xml": [r"<maven\.compiler\.release>\s*([\d.]+)", r"<release>\s*([\d.]+)", r"<java\.version>\s*([\d.]+)", r"<maven\.compiler\.source>\s*([\d.]+)", r"<source>\s*([\d.]+)"],
    "build.gradle.kts": [r"sourceCompatibility\s*=\s*JavaVersion\.toVersion\(\s*['\"]?(\d+)", r"sourceCompatibility\s*=\s*['\"]?(\d+)", r"targetCompatibility\s*=\s*JavaVersion\.toVersion\(\s*['\"]?(\d+)", r"targetCompatibility\s*=\s*['\"]?(\d+)",
                         r"toolchain\s*\{[^}]*JavaLanguageVersion\.of\(\s*(\d+)", r"toolchain\s*\{[^}]*java\.version\s*=\s*['\"]?(\d+)"],
    "build.gradle": [r"sourceCompatibility\s*=\s*['\"]?(\d+)", r"targetCompatibility\s*=\s*['\"]?(\d+)", r"toolchain\s*\{[^}]*java\.version\s*=\s*['\"]?(\d+)"],
    ".java-version": [r"^\s*([\d.]+)"],
}
# Annotations that make a type a configuration class.
CONFIGURATION_NOTES = ("Configuration", "SpringBootApplication")


@dataclass
class Settings:
    languages: list[str] = field(default_factory=lambda: ["java", "kotlin"])
    exclude_patterns: list[str] = field(default_factory=list)
    max_call_depth: int = 10
    rules_file: str = "rules.yaml"


def parse_settings(text: str | None) -> Settings:
    """Settings of a YAML mapping with languages, excludePatterns, maxCallDepth and rulesFile; what is missing or of another type stays as by default."""
    import yaml

    own = Settings()
    try:
        root = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return own
    root = root if isinstance(root, dict) else {}
    for key, name, kind in (("languages", "languages", list), ("excludePatterns", "exclude_patterns", list), ("maxCallDepth", "max_call_depth", int), ("rulesFile", "rules_file", str)):
        if isinstance(root.get(key), kind) and not isinstance(root.get(key), bool):
            setattr(own, name, [str(x) for x in root[key]] if kind is list else root[key])
    return own


def jdk_versions(files: DataFrame) -> DataFrame:
    """folder, jdk and supported of each folder with a build file in (path, content) rows: the first statement by file and pattern."""
    name, text = F.substring_index("path", "/", -1), F.col("content").cast("string")
    found = F.lit(None).cast("string")
    for file, patterns in JDK_PATTERNS.items():
        said = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
        found = F.coalesce(found, F.when(name == file, said))
    rank = F.array_position(F.array(*[F.lit(x) for x in JDK_PATTERNS]), name)
    rows = files.where(name.isin(list(JDK_PATTERNS))).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.struct(F.when(found.isNull(), 1).otherwise(0).alias("none"), rank.alias("rank"), found.alias("said")).alias("x"))
    best = rows.groupBy("folder").agg(F.min("x").alias("x"))
    major = F.coalesce(F.regexp_extract("x.said", r"(\d+)", 1).cast("int"), F.lit(DEFAULT_JDK))
    return best.select("folder", major.alias("jdk"), major.isin(list(MAJORS)).alias("supported"))


def config_bindings(symbols: DataFrame) -> DataFrame:
    """property_key, target_fqn, kind and member_name: configuration classes, prefixes, keys of value fields, and bean methods."""
    notes = F.coalesce("annotations", F.array().cast("array<string>"))
    rows = symbols.withColumn("notes", notes)
    types, none = rows.where("kind not in ('METHOD', 'FIELD')"), F.lit(None).cast("string")
    own = types.where(F.arrays_overlap("notes", F.array(*[F.lit(n) for n in CONFIGURATION_NOTES]))).select(F.col("qualified_name").alias("property_key"), F.col("qualified_name").alias("target_fqn"), F.lit("CONFIGURATION_CLASS").alias("kind"), none.alias("member_name"))
    said = F.array_join("notes", "\n")
    prefix = F.regexp_extract(said, r"@ConfigurationProperties\s*\(\s*(?:(?:prefix|value)\s*=\s*)?\"([^\"]+)\"", 1)
    prefixed = types.select(prefix.alias("property_key"), F.col("qualified_name").alias("target_fqn"), F.lit("CONFIGURATION_PROPERTIES").alias("kind"), none.alias("member_name")).where("property_key <> ''")
    keys = F.regexp_extract_all(F.array_join(F.filter("notes", lambda a: a.rlike(r"^@(\w+\.)*Value\s*\(")), "\n"), F.lit(r"\$\{([^}:]+)"), 1)
    fields = rows.where("kind = 'FIELD' and not coalesce(synthetic, false)") if "synthetic" in rows.columns else rows.where("kind = 'FIELD'")
    valued = fields.select(F.explode(F.array_distinct(keys)).alias("property_key"), F.col("parent_fqn").alias("target_fqn"), F.lit("VALUE_ANNOTATION").alias("kind"), F.col("name").alias("member_name"))
    beans = rows.where("kind = 'METHOD'").where(F.array_contains("notes", "Bean")).select(F.col("name").alias("property_key"), F.concat_ws("#", "parent_fqn", "name").alias("target_fqn"), F.lit("BEAN_METHOD").alias("kind"), F.col("name").alias("member_name"))
    return own.unionByName(prefixed).unionByName(valued).unionByName(beans)


def write_bundle(path: str, tables: dict[str, DataFrame], commit: str) -> None:
    """Tables below path/commit as Parquet, each with a digest in a manifest that is written last: a bundle without one is not whole."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{commit}/{name}")
        rows.append((name, *_digest(spark.read.parquet(f"{path}/{commit}/{name}"))))
    spark.createDataFrame(rows, "name string, rows long, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/{commit}/manifest")


def read_bundle(spark: SparkSession, path: str, commit: str) -> dict[str, DataFrame]:
    """The tables of a bundle; an error if one is not as its manifest says, no tables if there is no manifest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{commit}/manifest/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    out = {}
    for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/{commit}/manifest").collect():
        out[r["name"]] = spark.read.parquet(f"{path}/{commit}/{r['name']}")
        if _digest(out[r["name"]]) != (r["rows"], r["digest"]):
            raise ValueError(f"bundle {commit}: table {r['name']} is not as its manifest says")
    return out


def _digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row hashes that no order of rows or files changes."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return r[0], str(r[1] or 0)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a symbol, in as many files as there are tasks."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)


CASES = "array<struct<name: string, description: string, expectations: array<struct<sourceFqn: string, targetOwner: string, kind: string, minConfidence: string>>>>"


def evaluation_cases(files: DataFrame) -> DataFrame:
    """files: content (binary), each a JSON list of cases. case_name, source_fqn, target_owner, kind (CALLS) and min_confidence (POSSIBLE): a row an
    expectation, as analyse.evaluate() takes them. Unknown keys are left out; a text that is no such list, and a case without a name or an
    expectation without both ends, are errors."""
    # a text with an error gives a row with null, and that is looked at
    read = files.select(F.col("content").cast("string").alias("text")).select("text", F.from_json("text", CASES).alias("cases"))
    wrong = lambda bad, what: F.when(bad, F.raise_error(F.lit(what)))
    case = read.select(F.explode(F.coalesce("cases", wrong(F.col("cases").isNull(), "not a list of cases").cast(CASES))).alias("c"))
    one = case.select(F.coalesce("c.name", wrong(F.col("c.name").isNull(), "a case has no name").cast("string")).alias("case_name"), F.explode("c.expectations").alias("e"))
    ends = [F.coalesce(f"e.{c}", wrong(F.col(f"e.{c}").isNull(), f"an expectation has no {c}").cast("string")).alias(n) for c, n in (("sourceFqn", "source_fqn"), ("targetOwner", "target_owner"))]
    return one.select("case_name", *ends, F.coalesce("e.kind", F.lit("CALLS")).alias("kind"), F.coalesce("e.minConfidence", F.lit("POSSIBLE")).alias("min_confidence"))


CACHE = "key string, build_hash string, classpath string, resolved_at timestamp"


def store_classpaths(rows: DataFrame, path: str) -> None:
    """Adds resolved class paths (key, build_hash, classpath, resolved_at; by default now) to the cache at path. Files are added, none is changed,
    so a lost write leaves the cache as it was."""
    at = F.col("resolved_at") if "resolved_at" in rows.columns else F.current_timestamp()
    rows.select("key", "build_hash", "classpath", at.alias("resolved_at")).write.mode("append").json(path)


def cached_classpaths(spark, path: str) -> DataFrame:
    """key, build_hash and classpath of the cache: of a key the last by time, then text. Lines that can't be read are misses; no cache: no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE).drop("resolved_at")
    rows = spark.read.schema(CACHE).json(path).where("key is not null and resolved_at is not null")
    last = rows.groupBy("key").agg(F.max(F.struct("resolved_at", "build_hash", "classpath")).alias("l"))
    return last.select("key", "l.build_hash", "l.classpath")
