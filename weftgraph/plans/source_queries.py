"""Queries of the way from sources to a graph, over source trees that are written from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import analyse, linking, refactor
from weftgraph.plans import emit
from weftgraph.plans.queries import VIEWS, query
from weftgraph.plans.scratch import new_path, stored
from weftgraph.sources import config, graph_store, parsers, project, repository
from weftgraph.sources.derived import edges, order_symbols, symbols, table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(rows, module: str, folder: str, name, text, test: bool = False):
    root = "src/test/java" if test else "src/main/java"
    return rows.select(F.lit(module).alias("module"), _text(f"{root}/{folder}/", name, ".java").alias("path"), F.lit(root).alias("root"), F.lit(test).alias("is_test"), text.cast("binary").alias("content"))


def java_tree(spark, d):
    """Java sources: a type a region, nation and supplier, an interface with one implementation, and tests of every fifth supplier."""
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    regions = _text("package geo.region;\npublic class R", r, " implements Zone {\n  public int enter(int day) { return day; }\n  private void rest() { enter(", r, "); }\n}\n")
    zone = _text("package geo.region;\npublic interface Zone { int enter(int day); }\n")
    nations = _text("package geo.nation;\nimport geo.region.R", F.col("n_regionkey"), ";\nimport java.util.List;\n// class Ghost", n, " { }\n@Service\npublic class N", n,
                    " {\n  private final R", F.col("n_regionkey"), " region;\n  public N", n, "(R", F.col("n_regionkey"), " region) { this.region = region; }\n  public int visit(int day) { return region.enter(day); }\n}\n")
    suppliers = _text("package catalog.supplier;\nimport geo.nation.N", F.col("s_nationkey"), ";\nimport lost.Thing", s % 3, ";\npublic class S", s, " {\n  N", F.col("s_nationkey"), " home;\n  @Value(\"${supply.s", s,
                      ".limit:9}\") String limit;\n  public int ship() { return home.visit(", s, "); }\n}\n")
    tests = _text("package catalog.supplier;\npublic class S", s, "Test {\n  @Test void ships() { S", s, " one = new S", s, "(); one.ship(); }\n}\n")
    return (_files(region, "geo", "geo/region", _text("R", r), regions).unionByName(_files(spark.range(1), "geo", "geo/region", _text("Zone"), zone))
            .unionByName(_files(nation, "geo", "geo/nation", _text("N", n), nations)).unionByName(_files(supplier, "catalog", "catalog/supplier", _text("S", s), suppliers))
            .unionByName(_files(supplier.where(s % 5 == 0), "catalog", "catalog/supplier", _text("S", s, "Test"), tests, True)))


def _facts(spark, d):
    return stored(parsers.extract(java_tree(spark, d)), "facts")


@query("""SELECT 'geo' AS module, 'CLASS' AS kind, 'geo.region.R'||r_regionkey AS qualified_name FROM region UNION ALL SELECT 'geo','INTERFACE','geo.region.Zone'
UNION ALL SELECT 'geo','CLASS','geo.nation.N'||n_nationkey FROM nation UNION ALL SELECT 'catalog','CLASS','catalog.supplier.S'||s_suppkey FROM supplier
UNION ALL SELECT 'catalog','CLASS','catalog.supplier.S'||s_suppkey||'Test' FROM supplier WHERE s_suppkey%5=0
UNION ALL SELECT 'geo','METHOD','geo.region.R'||r_regionkey||'#enter(int)' FROM region UNION ALL SELECT 'geo','METHOD','geo.region.R'||r_regionkey||'#rest()' FROM region UNION ALL SELECT 'geo','METHOD','geo.region.Zone#enter(int)'
UNION ALL SELECT 'geo','METHOD','geo.nation.N'||n_nationkey||'#visit(int)' FROM nation UNION ALL SELECT 'geo','METHOD','geo.nation.N'||n_nationkey||'#<init>(R'||n_regionkey||')' FROM nation UNION ALL SELECT 'geo','FIELD','geo.nation.N'||n_nationkey||'#region' FROM nation
UNION ALL SELECT 'catalog','METHOD','catalog.supplier.S'||s_suppkey||'#ship()' FROM supplier UNION ALL SELECT 'catalog','FIELD','catalog.supplier.S'||s_suppkey||'#home' FROM supplier UNION ALL SELECT 'catalog','FIELD','catalog.supplier.S'||s_suppkey||'#limit' FROM supplier
UNION ALL SELECT 'catalog','METHOD','catalog.supplier.S'||s_suppkey||'Test#ships()' FROM supplier WHERE s_suppkey%5=0""")
def source_symbols(spark, d):
    return linking.symbols_of(_facts(spark, d)).select("module", "kind", "qualified_name")


@query("""SELECT 'geo.region.R'||r_regionkey AS source_fqn, 'geo.region.Zone' AS target_fqn, 'IMPLEMENTS' AS kind, 'CONFIRMED' AS confidence FROM region
UNION ALL SELECT 'geo.region.R'||r_regionkey, 'geo.region.R'||r_regionkey||'#enter', 'CALLS', 'CONFIRMED' FROM region
UNION ALL SELECT 'geo.nation.N'||n_nationkey, 'geo.region.R'||n_regionkey, 'IMPORTS', 'CONFIRMED' FROM nation
UNION ALL SELECT 'geo.nation.N'||n_nationkey, 'geo.region.R'||n_regionkey, 'USES', 'POSSIBLE' FROM nation
UNION ALL SELECT 'geo.nation.N'||n_nationkey, 'geo.region.R'||n_regionkey||'#enter', 'CALLS', 'CONFIRMED' FROM nation
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey, 'IMPORTS', 'CONFIRMED' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey, 'USES', 'POSSIBLE' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey||'#visit', 'CALLS', 'CONFIRMED' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey||'#<init>', 'CALLS', 'CONFIRMED' FROM supplier WHERE s_suppkey%5=0
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey||'#ship', 'CALLS', 'CONFIRMED' FROM supplier WHERE s_suppkey%5=0
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey, 'TESTS', 'CONFIRMED' FROM supplier WHERE s_suppkey%5=0""")
def source_edges(spark, d):
    got = linking.link(_facts(spark, d)).where("not startswith(target_fqn, 'java.') and not startswith(target_fqn, 'lost.')")
    return got.select("source_fqn", "target_fqn", "kind", "confidence").distinct()


def language_tree(spark, d):
    """A type a supplier that holds its nation, in four languages, each in packages of its own."""
    rows, s, n = table(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    texts = {
        "kt": ("src/main/kotlin", _text("package kt.supply\nimport kt.geo.N", n, "\nclass S", s, "(private val home: N", n, ") : Place() {\n  fun ship(day: Int): N", n, " { return home.visit(day) }\n}\n")),
        "ts": ("src", _text("import { N", n, " } from '../geo/n", n, "';\nexport class S", s, " extends Place {\n  constructor(private home: N", n, ") { super(); }\n  ship(day: number) { return this.home.visit(day); }\n}\n")),
        "py": ("app", _text("from geo.n", n, " import N", n, "\nclass S", s, "(Place):\n    def __init__(self, home: N", n, "):\n        self.home = home\n    def ship(self, day: int):\n        return self.home.visit(day)\n")),
        "go": ("src", _text("package supply\nimport (\n    \"example.org/geo\"\n)\ntype S", s, " struct {\n    Home *geo.N", n, "\n}\nfunc (s *S", s, ") Ship(to *geo.N", n, ", day int) int {\n    return 1\n}\n")),
    }
    out = None
    for extension, (root, text) in texts.items():
        own = rows.select(F.lit(extension).alias("module"), _text(f"{root}/supply/", F.lower(_text("S", s)), f".{extension}").alias("path"), F.lit(root).alias("root"), F.lit(False).alias("is_test"), text.cast("binary").alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT m AS module, kind, replace(p, '?', 'S'||s_suppkey) AS qualified_name FROM supplier, LATERAL (VALUES ('kt','CLASS','kt.supply.?'),('kt','FIELD','kt.supply.?#home'),('kt','METHOD','kt.supply.?#ship(Int)'),
 ('ts','CLASS','supply.?'),('ts','FIELD','supply.?#home'),('ts','METHOD','supply.?#constructor(N'||s_nationkey||')'),('ts','METHOD','supply.?#ship(number)'),
 ('py','CLASS','supply.?'),('py','FIELD','supply.?#home'),('py','METHOD','supply.?#__init__(home)'),('py','METHOD','supply.?#ship(day)'),
 ('go','CLASS','supply.?'),('go','FIELD','supply.?#Home'),('go','METHOD','supply.?#Ship(*geo.N'||s_nationkey||',int)')) t(m, kind, p)""")
def language_symbols(spark, d):
    return linking.symbols_of(stored(parsers.extract(language_tree(spark, d)), "facts")).select("module", "kind", "qualified_name")


@query("""SELECT m AS module, CASE WHEN m='kt' THEN 'kt.' ELSE '' END||'supply.S'||s_suppkey AS source_fqn, replace(p, '?', s_nationkey::VARCHAR) AS target_fqn, kind FROM supplier,
 (VALUES ('kt','kt.geo.N?','IMPORTS'),('kt','kt.geo.N?','CALLS'),('kt','kt.geo.N?','USES'),('ts','../geo/n?','IMPORTS'),('ts','../geo/n?','CALLS'),('ts','../geo/n?','USES'),
 ('py','geo.n?.N?','IMPORTS'),('py','geo.n?.N?','CALLS'),('py','geo.n?.N?','USES'),('go','example.org/geo','IMPORTS'),('go','example.org/geo.N?','USES')) t(m, p, kind)""")
def language_edges(spark, d):
    got = linking.link(stored(parsers.extract(language_tree(spark, d)), "facts"))
    return got.where("kind <> 'EXTENDS'").select("module", "source_fqn", "target_fqn", "kind").distinct()


def edited_tree(spark, d):
    """java_tree() after an edit: even regions inherit enter from a new base type, and tests of every tenth supplier are gone."""
    region = table(spark, d, "region")
    r = F.col("r_regionkey")
    heirs = _text("package geo.region;\npublic class R", r, " extends Base {\n  private void rest() { enter(", r, "); }\n}\n")
    base = _text("package geo.region;\npublic class Base implements Zone {\n  public int enter(int day) { return day; }\n}\n")
    gone = F.col("path").rlike("/S[0-9]*0Test") | F.col("path").rlike("/R[0-9]*[02468][.]java$")
    return java_tree(spark, d).where(~gone).unionByName(_files(region.where(r % 2 == 0), "geo", "geo/region", _text("R", r), heirs)).unionByName(_files(spark.range(1), "geo", "geo/region", _text("Base"), base))


@query("""SELECT 'geo.region.R'||r_regionkey AS source_fqn, CASE WHEN r_regionkey%2=0 THEN 'geo.region.Base' ELSE 'geo.region.Zone' END AS target_fqn, CASE WHEN r_regionkey%2=0 THEN 'EXTENDS' ELSE 'IMPLEMENTS' END AS kind, 'CONFIRMED' AS confidence FROM region
UNION ALL SELECT 'geo.region.Base', 'geo.region.Zone', 'IMPLEMENTS', 'CONFIRMED'
UNION ALL SELECT 'geo.region.R'||r_regionkey, CASE WHEN r_regionkey%2=0 THEN 'geo.region.Base' ELSE 'geo.region.R'||r_regionkey END||'#enter', 'CALLS', 'CONFIRMED' FROM region
UNION ALL SELECT 'geo.nation.N'||n_nationkey, 'geo.region.R'||n_regionkey, 'IMPORTS', 'CONFIRMED' FROM nation
UNION ALL SELECT 'geo.nation.N'||n_nationkey, 'geo.region.R'||n_regionkey, 'USES', 'POSSIBLE' FROM nation
UNION ALL SELECT 'geo.nation.N'||n_nationkey, CASE WHEN n_regionkey%2=0 THEN 'geo.region.Base' ELSE 'geo.region.R'||n_regionkey END||'#enter', 'CALLS', 'CONFIRMED' FROM nation
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey, 'IMPORTS', 'CONFIRMED' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey, 'USES', 'POSSIBLE' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey||'#visit', 'CALLS', 'CONFIRMED' FROM supplier
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey||'#<init>', 'CALLS', 'CONFIRMED' FROM supplier WHERE s_suppkey%10=5
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey||'#ship', 'CALLS', 'CONFIRMED' FROM supplier WHERE s_suppkey%10=5
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey||'Test', 'catalog.supplier.S'||s_suppkey, 'TESTS', 'CONFIRMED' FROM supplier WHERE s_suppkey%10=5""")
def edges_after_edit(spark, d):
    """The edges of a store that was made of one tree and brought up to another."""
    kept = graph_store.GraphStore(spark, new_path(spark, "edited-store"))
    graph_store.update(kept, java_tree(spark, d), parsers.extract)
    graph_store.update(kept, edited_tree(spark, d), parsers.extract)
    return kept.read("edges").where("not startswith(target_fqn, 'lost.') and not startswith(target_fqn, 'java.')").select("source_fqn", "target_fqn", "kind", "confidence").distinct()


def chained_tree(spark, d):
    """Customers that call their nation's region through two results, and what their nation inherits."""
    region, nation, customer = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    r, n, c = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    regions = _text("package geo.region;\npublic class R", r, " {\n  public int enter() { return 0; }\n  public int enter(int day) { return day; }\n}\n")
    place = _text("package geo.nation;\npublic class Place { void far() {} }\n")
    nations = _text("package geo.nation;\nimport geo.region.R", F.col("n_regionkey"), ";\npublic class N", n, " extends Place {\n  public R", F.col("n_regionkey"), " region() { return null; }\n}\n")
    own = F.col("c_nationkey")
    customers = _text("package sales;\nimport geo.nation.N", own, ";\npublic class C", c, " {\n  N", own, " home() { return null; }\n  void tour() { home().region().enter(", c, "); home().far(); home().lost(); }\n}\n")
    return (_files(region, "geo", "geo/region", _text("R", r), regions).unionByName(_files(spark.range(1), "geo", "geo/nation", _text("Place"), place))
            .unionByName(_files(nation, "geo", "geo/nation", _text("N", n), nations)).unionByName(_files(customer, "sales", "sales", _text("C", c), customers)))


@query("""SELECT 'sales.C'||c_custkey AS source_fqn, target_fqn, confidence FROM customer JOIN nation ON c_nationkey=n_nationkey, LATERAL (VALUES ('sales.C'||c_custkey||'#home','CONFIRMED'), ('geo.nation.N'||n_nationkey||'#region','CONFIRMED'),
 ('geo.region.R'||n_regionkey||'#enter','CONFIRMED'), ('geo.nation.Place#far','CONFIRMED'), ('geo.nation.N'||n_nationkey||'#lost','POSSIBLE')) t(target_fqn, confidence)""")
def chained_calls(spark, d):
    facts = stored(parsers.extract(chained_tree(spark, d)), "facts")
    return linking.link(facts).where("kind = 'CALLS'").select("source_fqn", "target_fqn", "confidence").distinct()


@query("""SELECT 'ports.Use'||s_suppkey||'Test' AS source_fqn, 'ports.Use'||s_suppkey AS target_fqn FROM supplier
UNION ALL SELECT 'ports.Use'||s_suppkey||'Test', 'ports.'||w||s_suppkey FROM supplier, (VALUES ('Port'),('Impl')) t(w) WHERE s_suppkey%2=1""")
def mocked_tests(spark, d):
    """TESTS edges of tests that replace an interface, and of tests that don't."""
    rows = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    port = _text("package ports;\npublic interface Port", k, " { void go(); }\n")
    impl = _text("package ports;\npublic class Impl", k, " implements Port", k, " { public void go() {} }\n")
    use = _text("package ports;\npublic class Use", k, " { Port", k, " port; void run() { port.go(); } }\n")
    test = _text("package ports;\npublic class Use", k, "Test {\n  ", F.when(k % 2 == 0, "@Mock ").otherwise(""), "Port", k, " port;\n  @Test void runs() { Use", k, " u = new Use", k, "(); u.run(); Impl", k, " i = new Impl", k, "(); i.go(); port.go(); }\n}\n")
    tree = _files(rows, "p", "ports", _text("Port", k), port).unionByName(_files(rows, "p", "ports", _text("Impl", k), impl)).unionByName(_files(rows, "p", "ports", _text("Use", k), use)).unionByName(_files(rows, "p", "ports", _text("Use", k, "Test"), test, True))
    return linking.link(stored(parsers.extract(tree), "facts")).where("kind = 'TESTS'").select("source_fqn", "target_fqn")


@query("""SELECT 'src/main/java/geo/region/R'||r_regionkey||'.java' AS path, 1 AS changes, '--- a/src/main/java/geo/region/R'||r_regionkey||'.java'||chr(10)||'+++ b/src/main/java/geo/region/R'||r_regionkey||'.java'||chr(10)||'@@ -4,3 +4,3 @@'||chr(10)
||'-  private void rest() { enter('||r_regionkey||'); }'||chr(10)||'-}'||chr(10)||'-'||chr(10)||'+  private void rest() { admit('||r_regionkey||'); }'||chr(10)||'+}'||chr(10)||'+'||chr(10) AS diff FROM region""")
def rename_diffs(spark, d):
    """Diffs of sources after a call is renamed."""
    return refactor.plan(java_tree(spark, d).where("path like '%/R%.java'"), [{"do": "rename", "from": "enter", "to": "admit"}]).select("path", "changes", "diff")


@query("""WITH e AS (SELECT 'c'||o_orderpriority AS case_name, 'sales.order.O'||l_orderkey AS s, 'catalog.part.P'||l_partkey AS t, l_linestatus FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_linenumber=1)
SELECT case_name, s AS source_fqn, t AS target_owner, 'CALLS' AS kind, CASE WHEN l_linestatus='F' THEN 'CONFIRMED' ELSE 'POSSIBLE' END AS min_confidence FROM e""")
def eval_cases_json(spark, d):
    """Expectations read from JSON texts, one text an order."""
    line = table(spark, d, "lineitem").where("l_linenumber = 1").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    least = F.when(F.col("l_linestatus") == "F", ', "minConfidence": "CONFIRMED"').otherwise("")
    text = _text('[{"name": "c', F.col("o_orderpriority"), '", "seen": 1, "expectations": [{"sourceFqn": "sales.order.O', F.col("l_orderkey"), '", "targetOwner": "catalog.part.P', F.col("l_partkey"), '"', least, "}]}]")
    return project.evaluation_cases(line.select(text.cast("binary").alias("content")))


@query("""SELECT 'k'||o_custkey AS key, arg_max('lib'||o_orderkey||'.jar', o_orderkey) AS classpath FROM orders GROUP BY o_custkey""")
def classpath_store(spark, d):
    """A cache that was written in two batches, as it is read back: the last of a key."""
    path, key = new_path(spark, "classpaths"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(_text("k", F.col("o_custkey")).alias("key"), F.lit("h").alias("build_hash"), _text("lib", key, ".jar").alias("classpath"), F.timestamp_seconds(key).alias("resolved_at"))
    for odd in (1, 0):
        project.store_classpaths(rows.where(key % 2 == odd), path)
    return project.cached_classpaths(spark, path).select("key", "classpath")


@query("""WITH t AS (SELECT 'f'||(p_partkey%7)||'.java' AS file_path, 'P'||p_partkey AS q, (p_partkey*37)%5000 AS a, (p_partkey*37)%5000+p_size*p_size AS b FROM part),
q AS (SELECT DISTINCT 'f'||(l_partkey%7)||'.java' AS file_path, (l_suppkey*l_linenumber*13)%9000 AS line FROM lineitem),
i AS (SELECT file_path, line, t.q AS symbol, row_number() OVER (PARTITION BY file_path, line ORDER BY a DESC, b, t.q) AS r FROM q JOIN t USING (file_path) WHERE line BETWEEN a AND b),
n AS (SELECT file_path, line, t.q AS symbol, row_number() OVER (PARTITION BY file_path, line ORDER BY abs(a-line), t.q) AS r FROM q JOIN t USING (file_path) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.file_path=q.file_path AND i.line=q.line))
SELECT file_path, CAST(line AS INT) AS line, symbol FROM (SELECT * FROM i WHERE r=1 UNION ALL SELECT * FROM n WHERE r=1)""")
def innermost_symbols(spark, d):
    """Overlapping line ranges of all parts in a few files, and positions of all lines of lineitem."""
    k = F.col("p_partkey")
    first = (k * 37 % 5000).cast("int")
    rows = table(spark, d, "part").select(_text("f", k % 7, ".java").alias("file_path"), _text("P", k).alias("qualified_name"), first.alias("line_start"), (first + F.col("p_size") * F.col("p_size")).cast("int").alias("line_end"))
    at = table(spark, d, "lineitem").select(_text("f", F.col("l_partkey") % 7, ".java").alias("file_path"), (F.col("l_suppkey") * F.col("l_linenumber") * 13 % 9000).cast("int").alias("line")).distinct()
    return analyse.symbol_at_line(rows, at, innermost=True)


@query("SELECT 'catalog' AS module, 'lost.Thing'||(s_suppkey%3) AS symbol, 'src/main/java/catalog/supplier/S'||s_suppkey||'.java' AS file_path FROM supplier")
def source_unresolved(spark, d):
    return linking.unresolved(_facts(spark, d)).select("module", "symbol", "file_path")


@query("SELECT 'supply.s'||s_suppkey||'.limit' AS property_key, 'catalog.supplier.S'||s_suppkey AS target_fqn, 'VALUE_ANNOTATION' AS kind, 'limit' AS member_name FROM supplier")
def source_bindings(spark, d):
    return project.config_bindings(linking.symbols_of(_facts(spark, d)))


@query("SELECT 'geo' AS module, 'src/main/java/geo/region/R'||r_regionkey||'.java' AS path, sha256('package geo.region;\npublic class R'||r_regionkey||' implements Zone {\n  public int enter(int day) { return day; }\n  private void rest() { enter('||r_regionkey||'); }\n}\n') AS hash FROM region")
def source_hashes(spark, d):
    rows = java_tree(spark, d).where("path like '%/R%.java'").select("path", "content")
    modules = spark.createDataFrame([("geo", "", "UNKNOWN", None)], "name string, path string, build_system string, build_file string")
    return repository.file_hashes(rows, modules)


@query("SELECT CASE WHEN s_suppkey%5=0 THEN 'src/test/java' ELSE 'src/main/java' END AS source_root, s_suppkey%5=0 AS is_test, CASE WHEN s_suppkey%5=0 THEN 'src/test/java' ELSE 'src/main/java' END||'/S'||s_suppkey||'.java' AS path FROM supplier WHERE s_suppkey%7<>0 AND NOT (s_suppkey::VARCHAR LIKE '1_')")
def source_files(spark, d):
    key = F.col("s_suppkey")
    kept = F.when(key % 5 == 0, "src/test/java/").otherwise("src/main/java/")
    ext = F.when(key % 7 == 0, ".txt").otherwise(".java")
    files = table(spark, d, "supplier").select(F.concat(kept, F.lit("S"), key.cast("string"), ext).alias("path"))
    modules = spark.createDataFrame([("m", "", "UNKNOWN", None)], "name string, path string, build_system string, build_file string")
    return repository.source_files(files, modules, [("", repository.parse_ignore("# none\nS1?.java\n"))]).select("source_root", "is_test", "path")


@query("""WITH p AS (SELECT page_id, regexp_replace(url,'^[a-z]+://','') AS path FROM pages)
SELECT page_id, (regexp_matches(path,'(^|/)(\\.git|node_modules)(/|$)') OR CASE WHEN regexp_matches(path,'(^|/)[^/]*1(/|$)') THEN false WHEN regexp_matches(path,'(^|/)[^/]*[0-9](/|$)') OR regexp_matches(path,'(^|/)www\\.[^/]*(/|$)') AND contains(path,'/') THEN true ELSE false END) AS ignored FROM p""")
def ignore_rules(spark, d):
    digits = "\n".join(f"*{i}" for i in range(10))
    rules = [("", repository.parse_ignore(f"{digits}\nwww.*/\n!*1\n"))]
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", repository.ignored(path, rules).alias("ignored"))


@query("SELECT 'm'||n_nationkey AS folder, CASE n_nationkey%4 WHEN 0 THEN 17 WHEN 1 THEN 11 WHEN 2 THEN 8 ELSE 21 END AS jdk, n_nationkey%4<>2 AS supported FROM nation")
def jdk_versions(spark, d):
    k = F.col("n_nationkey")
    pom = _text("<project><properties><java.version>", F.when(k % 4 == 0, "17.0").otherwise("8"), "</java.version></properties></project>")
    text = F.when(k % 2 == 0, pom).when(k % 4 == 1, F.lit("sourceCompatibility = '11'\n")).otherwise(F.lit("// nothing said\n"))
    name = F.when(k % 2 == 0, "pom.xml").otherwise("build.gradle")
    return project.jdk_versions(table(spark, d, "nation").select(_text("m", k, "/", name).alias("path"), text.cast("binary").alias("content")))


@query("""SELECT 'a b.k'||s_suppkey AS key, 'v='||s_nationkey AS value, '/r/m'||s_suppkey||'/src/main/resources/application-x.properties' AS source_file FROM supplier WHERE s_suppkey%2=0
UNION ALL SELECT 'plain'||s_suppkey, 'joined line', '/r/m'||s_suppkey||'/src/main/resources/application-x.properties' FROM supplier WHERE s_suppkey%2=0
UNION ALL SELECT 'café'||s_suppkey, '', '/r/m'||s_suppkey||'/src/main/resources/application-x.properties' FROM supplier WHERE s_suppkey%2=0
UNION ALL SELECT 'app.s'||s_suppkey||'.ports[0]', s_nationkey::VARCHAR, '/r/m'||s_suppkey||'/src/main/resources/application.yml' FROM supplier WHERE s_suppkey%2=1
UNION ALL SELECT 'app.s'||s_suppkey||'.live', 'true', '/r/m'||s_suppkey||'/src/main/resources/application.yml' FROM supplier WHERE s_suppkey%2=1""")
def config_files(spark, d):
    k = F.col("s_suppkey")
    properties = _text("# c\n! d\na\\ b.k", k, " : v=", F.col("s_nationkey"), "\nplain", k, " joined \\\n    line\ncaf\\u00e9", k, "\n")
    yaml = _text("app:\n  s", k, ":\n    ports: [", F.col("s_nationkey"), "]\n    live: true\n")
    name = F.when(k % 2 == 0, "application-x.properties").otherwise("application.yml")
    files = table(spark, d, "supplier").select(_text("/r/m", k, "/src/main/resources/", name).alias("path"), F.when(k % 2 == 0, properties).otherwise(yaml).cast("binary").alias("content"))
    return config.properties_of(files)


@query("""SELECT 'repo'||user_id AS repo_name, CASE user_id%4 WHEN 0 THEN 'SLACK' WHEN 1 THEN 'TEAMS' WHEN 2 THEN 'DISCORD' ELSE 'GENERIC' END AS provider, CASE WHEN count(*)>=5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CAST(count(*) AS INT) AS n_violations, true AS named
FROM events WHERE event_type='error' GROUP BY user_id""")
def alert_payloads(spark, d):
    violation = F.struct(F.lit("no-errors").alias("rule"), _text("test.user.U", F.col("user_id")).alias("source_fqn"), _text("event.E", F.col("event_id")).alias("target_fqn"), F.lit("CALLS").alias("edge_kind"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("message"))
    rows = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.array_sort(F.collect_list(violation)).alias("violations"))
    url = F.element_at(F.array(*[F.lit(u) for u in ("https://hooks.slack.com/x", "https://a.office.com/x", "https://discord.com/api/webhooks/1", "https://example.org")]), (F.col("user_id") % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    got = emit.payloads(rows.select(_text("repo", F.col("user_id")).alias("repo_name"), none.alias("commit_sha"), none.alias("branch"), none.alias("author"), F.timestamp_seconds(F.lit(0)).alias("at"), url.alias("url"), "violations"))
    return got.select("repo_name", "provider", "severity", "n_violations", F.col("payload").contains(F.col("repo_name")).alias("named"))


@query(VIEWS + "SELECT 'sales.order.O'||o_orderkey AS fqn FROM orders WHERE o_orderkey%4=0 UNION ALL SELECT qualified_name FROM y WHERE visibility='PUBLIC' AND coalesce(note,'') NOT IN ('RestController','Controller','SpringBootApplication','Configuration') AND qualified_name NOT IN (SELECT t FROM o WHERE kind<>'TESTS')")
def dead_code_with_orders(spark, d):
    return analyse.dead_code(edges(spark, d), symbols(spark, d).unionByName(order_symbols(spark, d)))


@query(VIEWS + "SELECT s AS fqn, coalesce(bool_or(o_orderstatus='F'),false) AS has_dynamic_dispatch FROM (SELECT DISTINCT split_part(source_fqn,'#',1) AS s FROM g WHERE kind='CALLS' UNION SELECT 'sales.order.O'||o_orderkey FROM orders WHERE o_orderstatus='F') LEFT JOIN orders ON s='sales.order.O'||o_orderkey GROUP BY 1")
def reflection(spark, d):
    from weftgraph.operators import traverse

    called = table(spark, d, "orders").where("o_orderstatus = 'F'").select(_text("sales.order.O", F.col("o_orderkey")).alias("source_fqn"), F.lit("java.lang.reflect.Method#invoke").alias("target_fqn"), F.lit("CALLS").alias("kind"))
    return traverse.dynamic_dispatch(edges(spark, d).select("source_fqn", "target_fqn", "kind").unionByName(called))


_JAVA_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w,''), lambda c: ord(c)::BIGINT)), lambda h, c: (h*31+c)%4294967296)"


@query(VIEWS + f""", t AS (SELECT qualified_name AS fqn, list_filter(regexp_split_to_array(lower(name),'[^a-z0-9_]+'), lambda w: length(w)>=2) AS words, list_filter(regexp_split_to_array(lower(qualified_name),'[^a-z0-9_]+'), lambda w: w<>'') AS names FROM y),
p AS (SELECT fqn, unnest(words) AS w, 1.0 AS x FROM t UNION ALL SELECT fqn, unnest(names), 2.0 FROM t UNION ALL SELECT fqn, substring(w,i,3), 0.5 FROM (SELECT fqn, w, unnest(range(1,length(w)-1)) AS i FROM (SELECT fqn, unnest(words) AS w FROM t))),
h0 AS (SELECT fqn, x, {_JAVA_HASH} AS h FROM p), h AS (SELECT fqn, x, CASE WHEN h>=2147483648 THEN h-4294967296 ELSE h END AS h FROM h0),
c AS (SELECT fqn, CAST(abs(h)%64 AS INT) AS dimension, sum(CASE WHEN h>=0 THEN x ELSE -x END) AS v FROM h GROUP BY 1,2), n AS (SELECT fqn, sqrt(sum(v*v)) AS norm FROM c GROUP BY 1)
SELECT fqn, dimension, round(v/norm,4) AS value FROM c JOIN n USING (fqn) WHERE v<>0""")
def hash_embedding_cells(spark, d):
    y = symbols(spark, d)
    got = analyse.hash_embedding(y.select(F.col("qualified_name").alias("fqn"), F.col("name").alias("text")), 64)
    return got.select("fqn", F.posexplode("embedding").alias("dimension", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 4))
