"""One query per operator over the derived graph of the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators import analyse, store, traverse
from weftgraph.sources.derived import edges, symbols, table

ROOT = "geo.region.R0"

#: The derived graph in SQL: edges g, owner-level edges o, symbols y.
VIEWS = """
WITH RECURSIVE g AS (
SELECT 'geo.nation.N'||n_nationkey AS source_fqn, 'geo.region.R'||n_regionkey AS target_fqn, 'CALLS' AS kind, 'CONFIRMED' AS confidence, 'geo' AS module, 0 AS line, '' AS caller_member FROM nation
UNION ALL SELECT 'catalog.supplier.S'||s_suppkey, 'geo.nation.N'||s_nationkey, 'CALLS','CONFIRMED','catalog',0,'' FROM supplier
UNION ALL SELECT 'sales.customer.C'||c_custkey, 'geo.nation.N'||c_nationkey, 'USES','CONFIRMED','sales',0,'' FROM customer
UNION ALL SELECT 'sales.order.O'||o_orderkey, 'sales.customer.C'||o_custkey, 'USES','POSSIBLE','sales',0,'' FROM orders
UNION ALL SELECT 'sales.order.O'||l_orderkey, 'catalog.part.P'||l_partkey||'#m'||l_linenumber, 'CALLS', CASE WHEN l_linestatus='F' THEN 'CONFIRMED' ELSE 'POSSIBLE' END,'sales', l_linenumber, l_returnflag FROM lineitem
UNION ALL SELECT DISTINCT 'catalog.part.P'||l_partkey, 'catalog.supplier.S'||l_suppkey, 'CALLS','CONFIRMED','catalog',0,'' FROM lineitem WHERE l_linenumber=1
UNION ALL SELECT 'catalog.part.P'||p_partkey, 'catalog.part.P'||((p_partkey*7+3)%(SELECT count(*) FROM part)), 'EXTENDS','CONFIRMED','catalog',0,'' FROM part
UNION ALL SELECT DISTINCT 'test.user.U'||user_id||'Test', 'sales.customer.C'||user_id, 'TESTS', 'CONFIRMED','test',0,'' FROM events WHERE event_type='purchase'),
o AS (SELECT DISTINCT split_part(source_fqn,'#',1) AS s, split_part(target_fqn,'#',1) AS t, kind FROM g),
y0 AS (
SELECT 'geo' AS module, 'region' AS part, 'R' AS letter, r_regionkey AS k, r_name AS name, 'Configuration' AS note FROM region
UNION ALL SELECT 'geo','nation','N',n_nationkey,n_name,NULL FROM nation
UNION ALL SELECT 'catalog','supplier','S',s_suppkey,s_name,NULL FROM supplier
UNION ALL SELECT 'sales','customer','C',c_custkey,c_name,CASE c_mktsegment WHEN 'BUILDING' THEN 'Controller' WHEN 'MACHINERY' THEN 'Repository' END FROM customer
UNION ALL SELECT 'catalog','part','P',p_partkey,p_name,CASE p_type WHEN 'PROMO' THEN 'Deprecated' WHEN 'ECONOMY' THEN 'Entity' END FROM part),
y AS (SELECT module, CASE WHEN k%5=0 THEN 'INTERFACE' ELSE 'CLASS' END AS kind, name, module||'.'||part||'.'||letter||k AS qualified_name, module||'.'||part AS package,
 module||'/'||part||(k%10)||'.java' AS file_path, k%50*10 AS line_start, k%50*10+8 AS line_end, CASE k%4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' WHEN 2 THEN 'PRIVATE' ELSE 'PACKAGE' END AS visibility, note FROM y0)
"""
PAIRS = """, pp AS (SELECT regexp_replace(split_part(source_fqn,'#',1),'\\.[^.]*$','') AS src, regexp_replace(split_part(target_fqn,'#',1),'\\.[^.]*$','') AS dst, kind FROM g)
"""


def _closure(name: str, roots: str, kinds: str, incoming: bool = True, depth: int | None = None) -> str:
    at, then = ("t", "s") if incoming else ("s", "t")
    if depth is None:
        return f", {name}(root, node) AS (SELECT DISTINCT r.root, o.{then} FROM ({roots}) r JOIN o ON o.{at}=r.root WHERE o.kind IN ({kinds}) UNION SELECT c.root, o.{then} FROM {name} c JOIN o ON o.{at}=c.node WHERE o.kind IN ({kinds}))\n"
    return f", {name}(root, node, d) AS (SELECT DISTINCT r.root, o.{then}, 1 FROM ({roots}) r JOIN o ON o.{at}=r.root WHERE o.kind IN ({kinds}) UNION SELECT c.root, o.{then}, d+1 FROM {name} c JOIN o ON o.{at}=c.node WHERE o.kind IN ({kinds}) AND d<{depth})\n"


CALL, DEP = "'CALLS'", "'CALLS','USES','EXTENDS','IMPLEMENTS'"
ONE, GEO = f"SELECT '{ROOT}' AS root", "SELECT qualified_name AS root FROM y WHERE module='geo'"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _geo(spark, d) -> DataFrame:
    return symbols(spark, d).where("module = 'geo'").select(F.col("qualified_name").alias("root"))


@query(VIEWS + _closure("c", ONE, CALL) + f"SELECT node FROM c WHERE node<>'{ROOT}'")
def transitive_callers(spark, d):
    return traverse.transitive_callers(edges(spark, d), ROOT).select("node")


@query(VIEWS + _closure("c", ONE, CALL, depth=2) + f"SELECT node, CAST(min(d) AS INT) AS depth FROM c WHERE node<>'{ROOT}' GROUP BY node")
def transitive_callers_depth2(spark, d):
    return traverse.transitive_callers(edges(spark, d), ROOT, 2)


@query(VIEWS + _closure("c", "SELECT 'sales.order.O7' AS root", CALL, False) + "SELECT node FROM c WHERE node<>'sales.order.O7'")
def transitive_callees(spark, d):
    return traverse.transitive_callees(edges(spark, d), "sales.order.O7").select("node")


@query(VIEWS + _closure("c", ONE, DEP) + f"SELECT node FROM c WHERE node<>'{ROOT}'")
def transitive_dependents(spark, d):
    return traverse.transitive_dependents(edges(spark, d), ROOT).select("node")


@query(VIEWS + _closure("c", ONE, DEP) + f"SELECT DISTINCT source_fqn AS test FROM g WHERE kind='TESTS' AND target_fqn IN (SELECT node FROM c UNION ALL SELECT '{ROOT}')")
def affected_tests(spark, d):
    e = edges(spark, d)
    return traverse.affected_tests(e, traverse.roots_of(e, ROOT)).select("test")


@query(VIEWS + "SELECT source_fqn, target_fqn, confidence, line FROM g WHERE kind='CALLS' AND split_part(target_fqn,'#',1)='catalog.part.P5'")
def direct_callers(spark, d):
    return traverse.direct_callers(edges(spark, d), "catalog.part.P5").select("source_fqn", "target_fqn", "confidence", "line")


@query(VIEWS + "SELECT source_fqn, target_fqn, line FROM g WHERE kind='CALLS' AND confidence='CONFIRMED' AND split_part(source_fqn,'#',1)='sales.order.O7'")
def direct_callees(spark, d):
    return traverse.direct_callees(edges(spark, d), "sales.order.O7", "CONFIRMED").select("source_fqn", "target_fqn", "line")


@query(VIEWS + "SELECT DISTINCT s AS node FROM o WHERE t='geo.nation.N3' AND kind IN ('CALLS','USES')")
def direct_neighbors(spark, d):
    return traverse.neighbors(edges(spark, d), "geo.nation.N3", True, ("CALLS", "USES"))


@query(VIEWS + "SELECT source_fqn AS test FROM g WHERE kind='TESTS' AND target_fqn='sales.customer.C7'")
def related_tests(spark, d):
    return traverse.related_tests(edges(spark, d), "sales.customer.C7").select(F.col("source_fqn").alias("test"))


@query(VIEWS + "SELECT split_part(source_fqn,'#',1) AS fqn, bool_or(contains(target_fqn,'reflect')) AS has_dynamic_dispatch FROM g WHERE kind='CALLS' GROUP BY 1")
def dynamic_dispatch(spark, d):
    return traverse.dynamic_dispatch(edges(spark, d))


@query(VIEWS + PAIRS + "SELECT src, dst, count(*) AS weight FROM pp WHERE src<>dst GROUP BY 1,2")
def package_deps(spark, d):
    return traverse.package_pairs(edges(spark, d))


@query(VIEWS + "SELECT DISTINCT g.module, y.module AS target_module FROM g JOIN y ON y.qualified_name=split_part(target_fqn,'#',1) WHERE g.module<>y.module")
def module_deps(spark, d):
    return traverse.module_dependencies(edges(spark, d), symbols(spark, d))


@query(VIEWS + "SELECT name, qualified_name FROM y WHERE name ILIKE 'customer#00%' ORDER BY qualified_name LIMIT 100")
def symbol_prefix(spark, d):
    return store.name_prefix(symbols(spark, d), "customer#00").select("name", "qualified_name")


@query(VIEWS + "SELECT qualified_name, line_start FROM y WHERE file_path='sales/customer3.java' OR file_path LIKE '%sales/customer3.java' OR file_path LIKE '%customer3.java'")
def symbol_by_file(spark, d):
    return store.by_file(symbols(spark, d), "sales\\customer3.java").select("qualified_name", F.col("line_start").cast("long").alias("line_start"))


@query(VIEWS + "SELECT qualified_name, module FROM y WHERE note ILIKE '%deprecated%'")
def deprecated_symbols(spark, d):
    return store.deprecated_symbols(symbols(spark, d)).select("qualified_name", "module")


@query(VIEWS + "SELECT source_fqn, target_fqn, kind, line, caller_member, confidence FROM g WHERE starts_with(source_fqn,'catalog.') OR starts_with(target_fqn,'catalog.') ORDER BY source_fqn, target_fqn, kind, line, caller_member, confidence LIMIT 50 OFFSET 100")
def dep_graph_page(spark, d):
    scoped = edges(spark, d).where("startswith(source_fqn, 'catalog.') or startswith(target_fqn, 'catalog.')")
    cols = ["source_fqn", "target_fqn", "kind", "line", "caller_member", "confidence"]
    return store.page(scoped.select(*cols), cols, "100", 50)[0]


@query(VIEWS + ", u AS (SELECT count(*) AS n FROM g WHERE split_part(target_fqn,'#',1) NOT IN (SELECT qualified_name FROM y)) SELECT (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM y) AS symbols, n AS unresolved, floor((SELECT count(*) FROM y)/((SELECT count(*) FROM y)+n)*1000)/1000 AS rate FROM u")
def confidence_report(spark, d):
    e, y = edges(spark, d), symbols(spark, d)
    missing = e.join(y.select(F.col("qualified_name").alias("q")), ids.owner(F.col("target_fqn")) == F.col("q"), "left_anti")
    return store.confidence_report(e, y, missing)


@query(VIEWS + "SELECT source_fqn, target_fqn, kind, caller_member, line, module, CASE WHEN kind='USES' THEN 'CONFIRMED' ELSE max(confidence) END AS confidence FROM g GROUP BY source_fqn, target_fqn, kind, caller_member, line, module")
def edge_upsert(spark, d):
    e = edges(spark, d)
    return store.upsert_edges(e, e.where("kind = 'USES'").withColumn("confidence", F.lit("CONFIRMED")))


@query(VIEWS + "SELECT source_fqn, target_fqn, kind, confidence, caller_member, line FROM (SELECT *, row_number() OVER (PARTITION BY source_fqn, target_fqn, kind ORDER BY confidence, CASE WHEN caller_member<>'' THEN 0 ELSE 1 END, line, caller_member, module) AS r FROM g) WHERE r=1")
def edge_dedup_best(spark, d):
    return store.best_edges(edges(spark, d)).select("source_fqn", "target_fqn", "kind", "confidence", "caller_member", "line")


_IMPACT = VIEWS + _closure("up", GEO, CALL) + _closure("far", GEO, DEP) + """,
r AS (SELECT qualified_name AS root, visibility, kind, note FROM y WHERE module='geo'),
c AS (SELECT split_part(target_fqn,'#',1) AS root, CASE WHEN caller_member<>'' THEN source_fqn||'#'||caller_member ELSE source_fqn END AS caller, confidence FROM g WHERE kind='CALLS'),
z AS (SELECT root,
 (SELECT count(DISTINCT caller) FROM c WHERE c.root=r.root) AS direct_callers,
 (SELECT count(*) FROM up WHERE up.root=r.root AND node<>r.root) AS transitive_callers,
 (SELECT count(*) FROM far WHERE far.root=r.root AND node<>r.root) AS dependents,
 (SELECT count(DISTINCT source_fqn) FROM g JOIN far ON node=target_fqn WHERE g.kind='TESTS' AND far.root=r.root) AS affected_tests,
 (SELECT count(*) FROM g WHERE g.kind='CALLS' AND split_part(source_fqn,'#',1)=r.root) AS fan_out, visibility, kind, note FROM r),
s AS (SELECT *, least(100, CASE WHEN visibility='PUBLIC' OR kind='INTERFACE' THEN 30 ELSE 0 END + CASE WHEN direct_callers>=3 THEN 20 ELSE 0 END + CASE WHEN note IN ('Repository','Entity') THEN 20 ELSE 0 END + CASE WHEN fan_out>=5 THEN 15 ELSE 0 END + CASE WHEN affected_tests=0 THEN 10 ELSE 0 END) AS score FROM z)
"""


@query(_IMPACT + "SELECT root AS symbol, direct_callers, transitive_callers, dependents, affected_tests, fan_out, CAST(score AS INT) AS score, CASE WHEN score>=76 THEN 'CRITICAL' WHEN score>=51 THEN 'HIGH' WHEN score>=21 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s")
def impact_score(spark, d):
    return analyse.impact(edges(spark, d), symbols(spark, d), _geo(spark, d)).select("symbol", "direct_callers", "transitive_callers", "dependents", "affected_tests", "fan_out", "score", "level")


_ALL = "SELECT qualified_name AS root FROM y"


@query(VIEWS + _closure("up", _ALL, CALL) + _closure("far", _ALL, DEP) + """,
c AS (SELECT split_part(target_fqn,'#',1) AS root, count(DISTINCT CASE WHEN caller_member<>'' THEN source_fqn||'#'||caller_member ELSE source_fqn END) AS n FROM g WHERE kind='CALLS' GROUP BY 1),
u AS (SELECT root, count(*) AS n FROM up WHERE node<>root GROUP BY 1),
um AS (SELECT root, count(DISTINCT module) AS m FROM (SELECT root, node FROM up UNION SELECT qualified_name, qualified_name FROM y) JOIN y ON qualified_name=node GROUP BY 1),
f AS (SELECT root, count(*) AS n FROM far WHERE node<>root GROUP BY 1),
t AS (SELECT root, count(DISTINCT source_fqn) AS n FROM (SELECT root, node FROM far UNION SELECT qualified_name, qualified_name FROM y) JOIN g ON g.kind='TESTS' AND target_fqn=node GROUP BY 1)
SELECT qualified_name AS symbol, coalesce(c.n,0) AS direct_callers, coalesce(u.n,0) AS transitive_callers, coalesce(f.n,0) AS dependents, coalesce(t.n,0) AS affected_tests, coalesce(u.n,0)+1 AS affected_classes, greatest(1, coalesce(um.m,0)) AS affected_modules
FROM y LEFT JOIN c ON c.root=qualified_name LEFT JOIN u ON u.root=qualified_name LEFT JOIN um ON um.root=qualified_name LEFT JOIN f ON f.root=qualified_name LEFT JOIN t ON t.root=qualified_name""")
def impact_of_all_types(spark, d):
    """Every type as a root."""
    y = symbols(spark, d)
    got = analyse.impact(edges(spark, d), y, y.select(F.col("qualified_name").alias("root")))
    return got.select("symbol", "direct_callers", "transitive_callers", "dependents", "affected_tests", "affected_classes", "affected_modules")


@query(_IMPACT + """, k AS (SELECT DISTINCT caller FROM c WHERE root IN (SELECT root FROM r)), n AS (SELECT DISTINCT split_part(caller,'#',1) AS q FROM k UNION SELECT root FROM r)
SELECT CAST(max(score) AS INT) AS max_score, (SELECT count(*) FROM k) AS callers, (SELECT count(DISTINCT source_fqn) FROM g JOIN far ON node=target_fqn WHERE g.kind='TESTS') AS tests, (SELECT count(*) FROM n) AS classes, (SELECT count(DISTINCT y.module) FROM n JOIN y ON qualified_name=q) AS modules FROM s""")
def impact_diff(spark, d):
    return analyse.impact_diff(edges(spark, d), symbols(spark, d), _geo(spark, d)).select("max_score", "callers", "tests", "classes", "modules")


@query(VIEWS + _closure("near", "SELECT qualified_name AS root FROM y WHERE note='Deprecated'", CALL, depth=3) + _closure("far", "SELECT qualified_name AS root FROM y WHERE note='Deprecated'", DEP) + """,
c AS (SELECT split_part(target_fqn,'#',1) AS root, count(DISTINCT source_fqn) AS n FROM g WHERE kind='CALLS' GROUP BY 1),
b AS (SELECT root, count(DISTINCT node) AS n FROM near WHERE node<>root GROUP BY 1),
t AS (SELECT far.root, count(DISTINCT source_fqn) AS n FROM far JOIN g ON g.target_fqn=far.node AND g.kind='TESTS' GROUP BY 1),
z AS (SELECT qualified_name AS fqn, kind, coalesce(c.n,0) AS direct_callers, coalesce(b.n,0) AS blast_radius, coalesce(t.n,0) AS affected_tests FROM y LEFT JOIN c ON c.root=qualified_name LEFT JOIN b ON b.root=qualified_name LEFT JOIN t ON t.root=qualified_name WHERE note='Deprecated')
SELECT *, CAST(greatest(1,least(100, 10+least(40,direct_callers*5)+least(25,blast_radius*2)+15+CASE WHEN affected_tests=0 AND direct_callers>0 THEN 15 ELSE 0 END)) AS INT) AS effort FROM z""")
def deprecation_radar(spark, d):
    return analyse.deprecation_radar(edges(spark, d), symbols(spark, d)).select("fqn", "kind", "direct_callers", "blast_radius", "affected_tests", "effort")


RULES = [
    {"name": "sales-must-not-use-geo", "source": {"annotations": ["Controller", "Repository"]}, "target": {"pattern": r"^geo\."}},
    {"name": "deprecated-suppliers", "source": {"annotations": ["Deprecated"]}, "target": {"pattern": "S[0-9]*7"}, "kinds": ("CALLS",)},
]


@query(VIEWS + """, e AS (SELECT split_part(source_fqn,'#',1) AS source, split_part(target_fqn,'#',1) AS target, kind, line FROM g),
m AS (SELECT e.*, a.note AS sn FROM e JOIN y a ON a.qualified_name=source JOIN y b ON b.qualified_name=target WHERE source<>target)
SELECT rule, source, target, min(line) AS line FROM (SELECT 'sales-must-not-use-geo' AS rule, * FROM m WHERE kind IN ('CALLS','USES') AND sn IN ('Controller','Repository') AND regexp_matches(target,'^geo\\.')
UNION ALL SELECT 'deprecated-suppliers', * FROM m WHERE kind='CALLS' AND sn='Deprecated' AND regexp_matches(target,'S[0-9]*7')) GROUP BY 1,2,3""")
def rules_violations(spark, d):
    return analyse.rule_violations(edges(spark, d), symbols(spark, d), RULES)


_DEPRECATED = "SELECT qualified_name AS root FROM y WHERE note='Deprecated'"


@query(VIEWS + _closure("up", _DEPRECATED, CALL) + _closure("far", _DEPRECATED, DEP) + """,
r AS (SELECT qualified_name AS root, visibility, kind FROM y WHERE note='Deprecated'),
e AS (SELECT split_part(source_fqn,'#',1) AS source, split_part(target_fqn,'#',1) AS target FROM g WHERE kind='CALLS'),
v AS (SELECT DISTINCT source FROM e JOIN y b ON b.qualified_name=target WHERE source<>target AND source IN (SELECT root FROM r) AND regexp_matches(target,'S[0-9]*7')),
c AS (SELECT split_part(target_fqn,'#',1) AS root, CASE WHEN caller_member<>'' THEN source_fqn||'#'||caller_member ELSE source_fqn END AS caller, confidence FROM g WHERE kind='CALLS'),
k AS (SELECT root, node FROM up UNION SELECT root, split_part(caller,'#',1) FROM c WHERE root IN (SELECT root FROM r) UNION SELECT root, root FROM r),
n AS (SELECT root, count(*) AS classes, greatest(1, count(DISTINCT module)) AS modules FROM k LEFT JOIN (SELECT qualified_name, max(module) AS module FROM y GROUP BY 1) ON qualified_name=node GROUP BY 1),
d AS (SELECT root, count(DISTINCT caller) AS callers, count(DISTINCT caller) FILTER (WHERE confidence<>'POSSIBLE') AS certain, count(DISTINCT caller) FILTER (WHERE confidence='POSSIBLE') AS possible, count(DISTINCT caller) FILTER (WHERE contains(caller,'#')) AS methods FROM c GROUP BY 1),
t AS (SELECT far.root, count(DISTINCT source_fqn) AS tests FROM far JOIN g ON node=target_fqn WHERE g.kind='TESTS' GROUP BY 1),
o2 AS (SELECT source AS root, count(*) AS calls FROM e GROUP BY 1)
SELECT r.root AS symbol, coalesce(callers,0) AS direct_callers, coalesce(certain,0) AS certain_callers, coalesce(possible,0) AS possible_callers, coalesce(methods,0) AS affected_methods, classes AS affected_classes, modules AS affected_modules,
 CAST(least(100, CASE WHEN visibility='PUBLIC' OR kind='INTERFACE' THEN 30 ELSE 0 END + CASE WHEN coalesce(callers,0)>=3 THEN 20 ELSE 0 END + CASE WHEN coalesce(calls,0)>=5 THEN 15 ELSE 0 END + CASE WHEN coalesce(tests,0)=0 THEN 10 ELSE 0 END + CASE WHEN r.root IN (SELECT source FROM v) THEN 10 ELSE 0 END) AS INT) AS score
FROM r LEFT JOIN d USING (root) LEFT JOIN n USING (root) LEFT JOIN t USING (root) LEFT JOIN o2 USING (root)""")
def impact_radius(spark, d):
    e, y = edges(spark, d), symbols(spark, d)
    roots = y.where("array_contains(annotations, 'Deprecated')").select(F.col("qualified_name").alias("root"))
    violating = analyse.rule_violations(e, y, RULES[1:]).select(F.col("source").alias("fqn"))
    got = analyse.impact(e, y, roots, violating)
    return got.select("symbol", "direct_callers", "certain_callers", "possible_callers", "affected_methods", "affected_classes", "affected_modules", "score")


#: Nation to nation trade over all lines: the pairs with most lines, to the hundredth and its equals.
_TRADE = """WITH RECURSIVE r AS (SELECT 'n'||c_nationkey AS src, 'n'||s_nationkey AS dst, rank() OVER (ORDER BY count(*) DESC) AS r
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
 WHERE c_nationkey<>s_nationkey GROUP BY c_nationkey, s_nationkey), p AS (SELECT src, dst FROM r WHERE r<=100)"""


def _trade(spark, d, first: int = 100) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders, customers, suppliers = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "supplier")
    met = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    src, dst = (F.concat(F.lit("n"), F.col(c).cast("string")) for c in ("c_nationkey", "s_nationkey"))
    pairs = met.where("c_nationkey <> s_nationkey").groupBy(src.alias("src"), dst.alias("dst")).agg(F.sum("n").alias("n"))
    # at most the square of the nations in rows
    return pairs.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).where(F.col("r") <= first).select("src", "dst")


@query(_TRADE + """, c(root, node) AS (SELECT src, dst FROM p UNION SELECT c.root, p.dst FROM c JOIN p ON p.src=c.node),
m AS (SELECT a.root AS node, a.node AS other FROM c a JOIN c b ON a.root=b.node AND a.node=b.root WHERE a.root<>a.node)
SELECT node, least(node, min(other)) AS component, count(*)+1 AS size FROM m GROUP BY node""")
def scc(spark, d):
    return traverse.strongly_connected(_trade(spark, d))


@query(_TRADE + """, w(path) AS (SELECT [src, dst] FROM p WHERE src<dst
 UNION ALL SELECT list_append(path, dst) FROM w JOIN p ON p.src=path[-1] WHERE dst>path[1] AND NOT list_contains(path, dst)),
f AS (SELECT path FROM w JOIN p ON p.src=path[-1] AND p.dst=path[1])
SELECT array_to_string(min(path),' -> ') AS cycle FROM f GROUP BY list_sort(path) ORDER BY len(min(path)), min(path) LIMIT 100""")
def rules_cycles(spark, d):
    return traverse.simple_cycles(_trade(spark, d)).select(F.array_join("path", " -> ").alias("cycle"))


@query(VIEWS + PAIRS + "SELECT src, dst, count(*) AS weight FROM pp WHERE src<>dst AND kind<>'TESTS' AND src IN (SELECT package FROM y) AND dst IN (SELECT package FROM y) GROUP BY 1,2")
def package_weights(spark, d):
    return analyse.package_weights(edges(spark, d), symbols(spark, d))


@query(VIEWS + "SELECT source_fqn AS fqn, count(*) AS calls FROM g WHERE kind='CALLS' AND NOT regexp_matches(source_fqn,'(Test|Tests|IT)$') GROUP BY 1 HAVING count(*)>5 ORDER BY 2 DESC, 1 LIMIT 10")
def god_fan_out(spark, d):
    return analyse.god_fan_out(edges(spark, d), threshold=5)


@query(VIEWS + "SELECT t AS fqn, count(DISTINCT s) AS callers FROM o WHERE kind='CALLS' GROUP BY 1 HAVING count(DISTINCT s)>15 ORDER BY 2 DESC, 1 LIMIT 10")
def god_fan_in(spark, d):
    return analyse.god_fan_in(edges(spark, d))


@query(VIEWS + "SELECT qualified_name AS fqn FROM y WHERE visibility='PUBLIC' AND coalesce(note,'') NOT IN ('RestController','Controller','SpringBootApplication','Configuration') AND qualified_name NOT IN (SELECT t FROM o WHERE kind<>'TESTS')")
def dead_code(spark, d):
    return analyse.dead_code(edges(spark, d), symbols(spark, d))


@query(VIEWS + "SELECT qualified_name AS fqn FROM y WHERE visibility='PUBLIC' AND qualified_name NOT IN (SELECT t FROM o WHERE kind='TESTS') AND qualified_name IN (SELECT s FROM o)")
def untested_public(spark, d):
    return analyse.untested_public(edges(spark, d), symbols(spark, d))


@query(VIEWS + """, h AS (SELECT split_part(source_fqn,'#',1) AS src, split_part(target_fqn,'#',1) AS nxt, bool_or(kind='CALLS') AS call, bool_and(confidence='POSSIBLE') AS possible FROM g WHERE kind IN ('CALLS','USES') GROUP BY 1,2),
e AS (SELECT DISTINCT qualified_name AS entry, qualified_name IN (SELECT src FROM h WHERE call) AS only_calls FROM y WHERE note='Controller'),
w(entry, only_calls, path, possible_at) AS (SELECT entry, only_calls, [entry], CAST(NULL AS INT) FROM e
 UNION ALL SELECT entry, only_calls, list_append(path, nxt), coalesce(possible_at, CASE WHEN possible THEN CAST(len(path) AS INT) END) FROM w JOIN h ON src=path[-1] AND (NOT only_calls OR call) AND NOT list_contains(path, nxt) WHERE len(path)<6),
f AS (SELECT * FROM w WHERE len(path)=6 OR len(path)>1 AND NOT EXISTS (SELECT 1 FROM h WHERE src=path[-1] AND (NOT only_calls OR call) AND NOT list_contains(path, nxt))),
r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY len(path) DESC, path) AS r FROM f)
SELECT entry, array_to_string(path,' -> ') AS participants, coalesce(possible_at,0) AS possible_at FROM r WHERE r<=3 ORDER BY 1,2 LIMIT 15""")
def flows(spark, d):
    return analyse.flows(edges(spark, d), symbols(spark, d)).fillna(0, ["possible_at"])


@query(VIEWS + ", h AS (SELECT split_part(target_fqn,'#',1) AS root, count(*) AS incoming FROM g WHERE kind='CALLS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)" + _closure("far", "SELECT root FROM h", DEP) + """,
z AS (SELECT h.root, incoming, CASE WHEN visibility='PUBLIC' OR kind='INTERFACE' THEN 30 ELSE 0 END
 + CASE WHEN (SELECT count(DISTINCT CASE WHEN caller_member<>'' THEN source_fqn||'#'||caller_member ELSE source_fqn END) FROM g WHERE g.kind='CALLS' AND split_part(target_fqn,'#',1)=h.root)>=3 THEN 20 ELSE 0 END
 + CASE WHEN note IN ('Repository','Entity') THEN 20 ELSE 0 END + CASE WHEN (SELECT count(*) FROM g WHERE g.kind='CALLS' AND split_part(source_fqn,'#',1)=h.root)>=5 THEN 15 ELSE 0 END
 + CASE WHEN NOT EXISTS (SELECT 1 FROM g JOIN far ON node=target_fqn WHERE g.kind='TESTS' AND far.root=h.root) AND NOT EXISTS (SELECT 1 FROM g WHERE g.kind='TESTS' AND target_fqn=h.root) THEN 10 ELSE 0 END AS score FROM h LEFT JOIN y ON qualified_name=h.root)
SELECT root, incoming, CAST(score AS INT) AS score FROM z WHERE score>=21 ORDER BY score DESC, incoming DESC, root LIMIT 10""")
def hotspots(spark, d):
    return analyse.hotspots(edges(spark, d), symbols(spark, d)).select("root", "incoming", "score")


@query(VIEWS + PAIRS + ", w AS (SELECT src, dst, count(*) AS weight FROM pp WHERE src<>dst GROUP BY 1,2) SELECT * FROM w WHERE weight>=3 AND NOT EXISTS (SELECT 1 FROM w b WHERE b.src=w.dst AND b.dst=w.src)")
def unidirectional_pkgs(spark, d):
    return analyse.one_way_packages(edges(spark, d))


@query(VIEWS + "SELECT 'catalog' AS module, CASE WHEN count(DISTINCT package)=1 THEN min(package) END AS base_package FROM y WHERE starts_with(qualified_name,'catalog.part.')")
def base_package(spark, d):
    return analyse.base_package(symbols(spark, d).where("startswith(qualified_name, 'catalog.part.')")).select(F.lit("catalog").alias("module"), "base_package")


@query("SELECT 'doc'||doc_id AS path, CASE lang WHEN 'es' THEN 'deleted' WHEN 'de' THEN 'modified' END AS status FROM documents WHERE lang IN ('es','de') AND NOT (lang='de' AND upper(text)=text)")
def file_state_diff(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    before = docs.select(path.alias("path"), F.sha2("text", 256).alias("hash"))
    after = docs.where("lang <> 'es'").select(path.alias("path"), F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("hash"))
    return store.file_differences(before, after)


@query(VIEWS + "SELECT DISTINCT module FROM g WHERE kind IN ('IMPORTS','USES','CALLS','EXTENDS') AND module<>'geo' AND split_part(split_part(target_fqn,'#',1),'.',-1) IN (SELECT split_part(qualified_name,'.',-1) FROM y WHERE module='geo')")
def cross_module_invalidation(spark, d):
    names = symbols(spark, d).where("module = 'geo'").select(ids.simple_name(F.col("qualified_name")).alias("name"))
    return store.invalidated_modules(edges(spark, d), spark.createDataFrame([("geo",)], "module string"), names)


@query(VIEWS + """, x AS (SELECT 'flag-'||l_returnflag AS case_name, 'sales.order.O'||l_orderkey AS source_fqn, 'catalog.part.P'||l_partkey AS target_owner, 'CONFIRMED' AS floor FROM lineitem),
e AS (SELECT source_fqn, split_part(target_fqn,'#',1) AS owner, max(CASE WHEN confidence='CONFIRMED' THEN 1 ELSE 0 END) AS has FROM g WHERE kind='CALLS' GROUP BY 1,2),
h AS (SELECT case_name, count(*) FILTER (WHERE has=1) AS matched, count(*) AS total FROM x LEFT JOIN e ON e.source_fqn=x.source_fqn AND e.owner=x.target_owner GROUP BY 1),
p AS (SELECT case_name, count(*) AS spurious FROM g JOIN (SELECT DISTINCT case_name, source_fqn FROM x) q USING (source_fqn) WHERE kind='CALLS' AND NOT EXISTS (SELECT 1 FROM x WHERE x.case_name=q.case_name AND x.source_fqn=g.source_fqn AND x.target_owner=split_part(g.target_fqn,'#',1)) GROUP BY 1)
SELECT case_name, matched, total-matched AS missed, coalesce(spurious,0) AS spurious, CAST(round(matched/(matched+coalesce(spurious,0)),6) AS DOUBLE) AS precision, CAST(round(matched/total,6) AS DOUBLE) AS recall FROM h LEFT JOIN p USING (case_name)""")
def eval_precision_recall(spark, d):
    line = table(spark, d, "lineitem")
    wanted = line.select(F.concat(F.lit("flag-"), "l_returnflag").alias("case_name"), F.concat(F.lit("sales.order.O"), F.col("l_orderkey").cast("string")).alias("source_fqn"), F.concat(F.lit("catalog.part.P"), F.col("l_partkey").cast("string")).alias("target_owner"), F.lit("CALLS").alias("kind"), F.lit("CONFIRMED").alias("min_confidence"))
    return analyse.evaluate(edges(spark, d), wanted)


_HOST = "regexp_extract(url,'//([^/]+)',1)"
_ENDPOINTS = f"""WITH e AS (SELECT {_HOST} AS repo, replace(regexp_extract(url,'//([^./]+)',1),'-','') AS service, 'GET' AS m, regexp_replace(regexp_replace(url,'^[a-z]+://[^/]+',''),'[?#].*$','') AS raw, page_id, starts_with(url,'https') AS is_client FROM pages),
n AS (SELECT *, CASE WHEN regexp_replace(regexp_replace(raw,'[0-9]+','{{*}}'),'/+$','')='' THEN '/' ELSE regexp_replace(regexp_replace(raw,'[0-9]+','{{*}}'),'/+$','') END AS p FROM e),
l AS (SELECT c.repo AS client_repo, 'page.P'||c.page_id||'#get' AS client_fqn, t.repo AS target_repo, 'page.P'||t.page_id||'#get' AS target_fqn,
 row_number() OVER (PARTITION BY c.page_id ORDER BY CASE WHEN lower(c.service)=lower(t.service) OR contains(lower(t.service),lower(c.service)) OR contains(replace(replace(lower(t.repo),'-',''),'_',''),lower(c.service)) THEN 0 ELSE 1 END, t.repo, 'page.P'||t.page_id||'#get') AS r
 FROM n c JOIN n t ON c.p=t.p AND c.repo<>t.repo WHERE c.is_client AND NOT t.is_client)
"""


def _endpoints(spark, d) -> DataFrame:
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    return table(spark, d, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("repo_name"), F.regexp_extract("url", "//([^./]+)", 1).alias("service_name"), F.lit("GET").alias("http_method"),
                                           F.regexp_replace(raw, "[0-9]+", "{id}").alias("path"), F.concat(F.lit("page.P"), F.col("page_id").cast("string")).alias("declaring_fqn"), F.lit("get").alias("member_name"), F.col("url").startswith("https").alias("is_client"))


@query(_ENDPOINTS + "SELECT client_repo, client_fqn, target_repo, target_fqn FROM l WHERE r=1")
def federation_links(spark, d):
    return analyse.federation_links(_endpoints(spark, d)).select("client_repo", "client_fqn", "target_repo", "target_fqn")


@query(_ENDPOINTS + """SELECT target_fqn, target_repo, count(DISTINCT client_fqn) AS clients, count(DISTINCT client_repo) AS repos,
 CAST(count(DISTINCT client_fqn)+sum(CAST(regexp_extract(client_fqn,'P([0-9]+)#',1) AS BIGINT)%3) AS BIGINT) AS affected_callers FROM l WHERE r=1 GROUP BY 1,2""")
def federation_radius(spark, d):
    page = F.concat(F.lit("page.P"), F.col("page_id").cast("string"))
    times = F.explode(F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("page_id") % 3).cast("int")))
    calls = table(spark, d, "pages").select(page.alias("page"), times.alias("by")).select(F.concat("by", F.lit(".Caller")).alias("source_fqn"), F.concat("page", F.lit("#get")).alias("target_fqn"), F.lit("CALLS").alias("kind"))
    every = edges(spark, d).select("source_fqn", "target_fqn", "kind").unionByName(calls)
    return analyse.federation_radius(analyse.federation_links(_endpoints(spark, d)), every)


@query(VIEWS + _closure("b", "SELECT qualified_name AS root FROM y", CALL, depth=3) + """,
i AS (SELECT t AS q, string_agg(s, ', ' ORDER BY s) AS x FROM (SELECT DISTINCT s, t, dense_rank() OVER (PARTITION BY t ORDER BY s) AS r FROM o WHERE kind='CALLS') WHERE r<=5 GROUP BY 1),
u AS (SELECT s AS q, string_agg(t, ', ' ORDER BY t) AS x FROM (SELECT DISTINCT s, t, dense_rank() OVER (PARTITION BY s ORDER BY t) AS r FROM o WHERE kind='CALLS') WHERE r<=5 GROUP BY 1),
n AS (SELECT root AS q, count(DISTINCT node) AS x FROM b WHERE node<>root GROUP BY 1)
SELECT qualified_name AS fqn, kind||' '||qualified_name||' located in '||file_path||':'||line_start||'-'||line_end||coalesce('. Annotations: '||note,'')||coalesce('. Referenced by: '||i.x,'')||coalesce('. Invocations: '||u.x,'')||CASE WHEN n.x>0 THEN '. Transitive impact radius: '||n.x||' symbols' ELSE '' END AS summary
FROM y LEFT JOIN i ON i.q=qualified_name LEFT JOIN u ON u.q=qualified_name LEFT JOIN n ON n.q=qualified_name""")
def rag_summary(spark, d):
    return analyse.rag_documents(edges(spark, d), symbols(spark, d))


@query()
def hash_embedding(spark, d):
    y = symbols(spark, d)
    return analyse.hash_embedding(y.select(F.col("qualified_name").alias("fqn"), F.col("name").alias("text")), 64)


@query("WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE*x[2]::DOUBLE) AS p, list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE) AS a, list_transform(q, lambda x: x::DOUBLE*x::DOUBLE) AS b FROM embeddings, q) SELECT vec_id, round(list_sum(p)/sqrt(list_sum(a)*list_sum(b)),6) AS similarity FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return analyse.nearest(v.select("vec_id", "embedding"), v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))


@query("SELECT 'event.'||event_id||'.props.k' AS key, CAST(json_extract_string(props,'$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT 'event.'||event_id||'.type', event_type FROM events")
def config_flatten(spark, d):
    from weftgraph.sources.config import flatten_json

    e = table(spark, d, "events")
    base = F.concat(F.lit("event."), F.col("event_id").cast("string"))
    flat = flatten_json(e.select(base.alias("prefix"), F.concat(F.lit('{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('"}')).alias("json")))
    return flat.select("key", "value")


@query("SELECT p_brand AS property_key, count(*) AS bindings FROM part WHERE p_brand='Brand#1' OR starts_with(p_brand,'Brand#1.') GROUP BY 1")
def config_bindings(spark, d):
    from weftgraph.sources.config import bindings_for

    b = table(spark, d, "part").select(F.col("p_brand").alias("property_key"), F.concat(F.lit("catalog.part.P"), F.col("p_partkey").cast("string")).alias("target_fqn"))
    return bindings_for(b, "Brand#1").groupBy("property_key").agg(F.count("*").alias("bindings"))


@query(VIEWS + "SELECT package, note AS stereotype, count(*) AS n FROM y WHERE note IS NOT NULL GROUP BY 1,2")
def stereotype_counts(spark, d):
    return analyse.stereotype_counts(symbols(spark, d))


@query(VIEWS + """, q AS (SELECT DISTINCT file_path, line_start+5 AS line FROM y UNION SELECT DISTINCT file_path, line_start+9 FROM y),
m AS (SELECT q.file_path, q.line, qualified_name, row_number() OVER (PARTITION BY q.file_path, q.line ORDER BY CASE WHEN line BETWEEN line_start AND line_end THEN 0 ELSE 1 END, CASE WHEN line BETWEEN line_start AND line_end THEN line_start ELSE abs(line_start-line) END, qualified_name) AS r FROM q JOIN y ON y.file_path=q.file_path)
SELECT file_path, CAST(line AS INT) AS line, qualified_name AS symbol FROM m WHERE r=1""")
def hover_symbol_at_line(spark, d):
    y = symbols(spark, d)
    at = y.select("file_path", (F.col("line_start") + 5).alias("line")).union(y.select("file_path", (F.col("line_start") + 9).alias("line"))).distinct()
    return analyse.symbol_at_line(y, at)


@query("SELECT user_id, count(*) AS violations, CASE WHEN count(*)>=5 THEN 'CRITICAL' WHEN count(*)>=1 THEN 'HIGH' ELSE 'CLEAN' END AS severity FROM events WHERE event_type='error' GROUP BY 1")
def drift_severity(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("violations")).withColumn("severity", ids.drift_severity(F.col("violations")))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS first_change, max(ts) AS last_change, count(*) AS changes FROM n GROUP BY user_id, k")
def debounce_sessions(spark, d):
    from weftgraph.streaming.incremental import debounce

    return debounce(table(spark, d, "events"), "30 minutes", key="user_id")


@query(VIEWS + "SELECT k.kind, count(g.kind) AS n FROM (SELECT unnest(['IMPORTS','EXTENDS','IMPLEMENTS','USES','CALLS','TESTS']) AS kind) k LEFT JOIN g USING (kind) GROUP BY 1")
def edges_by_kind(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("IMPORTS", "EXTENDS", "IMPLEMENTS", "USES", "CALLS", "TESTS")], "kind string")
    return kinds.join(edges(spark, d).groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])


@query(VIEWS + PAIRS + "SELECT src, dst, count(*) AS edges FROM pp WHERE src<>dst GROUP BY 1,2")
def package_pair_counts(spark, d):
    e = edges(spark, d)
    return e.select(ids.package(F.col("source_fqn")).alias("src"), ids.package(F.col("target_fqn")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("edges"))


@query(VIEWS + "SELECT count(*) AS calls, count(*) FILTER (WHERE confidence='POSSIBLE') AS possible FROM g WHERE kind='CALLS'")
def resolution_quality(spark, d):
    return analyse.resolution_quality(edges(spark, d))


@query(VIEWS + _closure("up", GEO, CALL, depth=3) + """, c AS (SELECT split_part(target_fqn,'#',1) AS root, count(*) AS n FROM g WHERE kind='CALLS' GROUP BY 1), u AS (SELECT root, count(DISTINCT node) AS n FROM up WHERE node<>root GROUP BY 1)
SELECT qualified_name AS fqn, coalesce(c.n,0) AS direct_callers, coalesce(u.n,0) AS callers FROM y LEFT JOIN c ON c.root=qualified_name LEFT JOIN u ON u.root=qualified_name WHERE module='geo'""")
def code_lens(spark, d):
    return analyse.code_lens(edges(spark, d), _geo(spark, d))


@query(VIEWS + """SELECT source_fqn, target_fqn, kind, line FROM g WHERE kind IN ('CALLS','USES') AND split_part(source_fqn,'#',1) IN (SELECT qualified_name FROM y WHERE note IN ('Controller','Deprecated')) AND split_part(target_fqn,'#',1) IN (SELECT qualified_name FROM y WHERE package IN ('geo.nation','catalog.supplier'))""")
def layer_couplings(spark, d):
    y = symbols(spark, d).withColumn("fqn", F.col("qualified_name"))
    met = analyse.couplings(edges(spark, d), y.where(analyse.overlap(F.col("annotations"), ["Controller", "Deprecated"])), y.where(ids.package(F.col("fqn")).isin("geo.nation", "catalog.supplier")))
    return met.select("source_fqn", "target_fqn", "kind", "line")


@query(VIEWS + _closure("up", ONE, CALL) + """, a AS (SELECT caller, max(direct) AS direct FROM (SELECT node AS caller, false AS direct FROM up WHERE node<>root UNION ALL SELECT s, true FROM o WHERE kind='CALLS' AND t='%s') GROUP BY 1)
SELECT caller, direct, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a WHERE direct) AS direct_total FROM a ORDER BY caller LIMIT 50""" % ROOT)
def capped_callers(spark, d):
    return analyse.capped_callers(edges(spark, d), ROOT, 50)


@query("""WITH t AS (SELECT n_nationkey AS k, n_nationkey%2=1 AS is_client FROM nation), m AS (SELECT s_suppkey AS m, s_nationkey AS k, s_suppkey%4 AS w FROM supplier WHERE s_suppkey%4<3)
SELECT 'repo'||(t.k%3) AS repo_name, CASE WHEN is_client THEN 'svc-'||t.k ELSE 'repo'||(t.k%3) END AS service_name, CASE w WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS http_method,
'/n'||t.k||CASE w WHEN 0 THEN '/{id}' WHEN 1 THEN '/x'||m ELSE '/y' END AS path, 'geo.nation.N'||t.k AS declaring_fqn, 'm'||m AS member_name, is_client FROM t JOIN m USING (k)""")
def endpoint_extraction(spark, d):
    key = lambda c: F.col(c).cast("string")
    repo = F.concat(F.lit("repo"), (F.col("k") % 3).cast("string"))
    control = F.array(F.lit("RestController"), F.concat(F.lit('@RequestMapping("/n'), key("k"), F.lit('/")')))
    client = F.array(F.concat(F.lit('@FeignClient(name = "svc-'), key("k"), F.lit('")')), F.concat(F.lit('@RequestMapping(path = "n'), key("k"), F.lit('")')))
    types = table(spark, d, "nation").withColumn("k", F.col("n_nationkey")).select(repo.alias("repo_name"), F.lit("CLASS").alias("kind"), F.concat(F.lit("geo.nation.N"), key("k")).alias("qualified_name"), F.lit(None).cast("string").alias("parent_fqn"), F.when(F.col("k") % 2 == 1, client).otherwise(control).alias("annotations"))
    note = F.element_at(F.array(F.lit('@GetMapping("/{id}")'), F.concat(F.lit('@PostMapping(path="/x'), key("m"), F.lit('")')), F.lit('@RequestMapping(value = "y"; method = RequestMethod.PUT)'), F.lit("@Override")), (F.col("m") % 4 + 1).cast("int"))
    own = F.concat(F.lit("geo.nation.N"), key("k"))
    methods = table(spark, d, "supplier").withColumn("k", F.col("s_nationkey")).withColumn("m", F.col("s_suppkey")).select(repo.alias("repo_name"), F.lit("METHOD").alias("kind"), F.concat(own, F.lit("#m"), key("m"), F.lit("(String)")).alias("qualified_name"), own.alias("parent_fqn"), F.array(note).alias("annotations"))
    return analyse.endpoints(types.unionByName(methods))


@query(VIEWS + "SELECT DISTINCT module, file_path FROM y WHERE qualified_name IN (SELECT s FROM o WHERE kind='CALLS' AND t LIKE 'geo.%')")
def diagnostics_files(spark, d):
    hits = edges(spark, d).where("kind = 'CALLS' and target_fqn like 'geo.%'").select(ids.owner(F.col("source_fqn")).alias("qualified_name"))
    return symbols(spark, d).join(hits, "qualified_name", "left_semi").select("module", "file_path").distinct()


@query(VIEWS + "SELECT qualified_name, module FROM y WHERE module<>'catalog'")
def module_delete(spark, d):
    return store.delete_module(symbols(spark, d), "catalog").select("qualified_name", "module")


@query("SELECT vec_id, CASE WHEN vec_id%2=0 THEN label+1 ELSE label END AS label FROM embeddings")
def embedding_upsert(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label").withColumn("written", F.lit(0))
    new = old.where("vec_id % 2 = 0").select("vec_id", (F.col("label") + 1).alias("label"), F.lit(1).alias("written"))
    return store.keep_last(old.unionByName(new), ["vec_id"], [F.col("written")]).select("vec_id", "label")


@query(VIEWS + """, e AS (SELECT split_part(source_fqn,'#',1) AS source, split_part(target_fqn,'#',1) AS target, kind, line FROM g WHERE split_part(source_fqn,'#',1)<>split_part(target_fqn,'#',1) AND kind IN ('CALLS','USES')),
m AS (SELECT e.* FROM e JOIN y a ON a.qualified_name=source JOIN y b ON b.qualified_name=target)
SELECT 'three-tier-controller-to-repo-bypass' AS rule, source, target, min(line) AS line FROM m WHERE regexp_matches(source,'(.*\\.)?(controller|controllers|web|api)(\\..*)?') AND regexp_matches(target,'(.*\\.)?(repository|repositories|repo|dao|persistence)(\\..*)?') GROUP BY 1,2,3
UNION ALL SELECT 'sales-to-geo', source, target, min(line) FROM m WHERE regexp_matches(source,'sales\\.(.*\\.)?customer(\\..*)?') AND regexp_matches(target,'geo\\.nation(\\..*)?') GROUP BY 1,2,3""")
def preset_rules(spark, d):
    from weftgraph.sources.rules import parse_rules, preset, to_yaml

    own = [{"name": "sales-to-geo", "source": {"pattern": r"sales\.(.*\.)?customer(\..*)?"}, "target": {"pattern": r"geo\.nation(\..*)?"}, "kinds": ["CALLS", "USES"]}]
    return analyse.rule_violations(edges(spark, d), symbols(spark, d), parse_rules(to_yaml(preset("3-tier")[2:] + own)))
