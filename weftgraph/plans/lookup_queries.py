"""Queries of lookups, capped listings, summaries and store maintenance, registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import guards, ids
from weftgraph.operators import analyse, lookup, store, traverse
from weftgraph.plans.queries import CALL, ONE, PAIRS, ROOT, RULES, VIEWS, _closure, _trade, _TRADE, query
from weftgraph.sources.derived import edges, members, order_symbols, symbols, table

#: Method symbols in SQL (sources.derived.members).
MEMBERS = """, m0 AS (SELECT DISTINCT 'catalog' AS module, 'm'||l_linenumber AS name, 'catalog.part.P'||l_partkey AS parent, '(int)' AS args, 'catalog/part'||(l_partkey%10)||'.java' AS file_path, l_partkey%50*10+l_linenumber AS line_start, l_partkey+l_linenumber AS v FROM lineitem
 UNION ALL SELECT DISTINCT 'sales', 'o'||(o_orderkey%7), 'sales.customer.C'||o_custkey, '()', 'sales/customer'||(o_custkey%10)||'.java', o_custkey%50*10+o_orderkey%7, o_custkey+o_orderkey%7 FROM orders),
m AS (SELECT module, name, parent||'#'||name||args AS qualified_name, parent AS parent_fqn, file_path, line_start, CASE v%4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' WHEN 2 THEN 'PRIVATE' ELSE 'PACKAGE' END AS visibility FROM m0)
"""


@query(VIEWS + "SELECT qualified_name, kind, module, file_path FROM y WHERE qualified_name='catalog.part.P7'")
def symbol_by_fqn(spark, d):
    return lookup.by_fqn(symbols(spark, d), "catalog.part.P7").select("qualified_name", "kind", "module", "file_path")


@query(VIEWS + "SELECT count(*) AS n FROM y WHERE name ILIKE 'customer#00%'")
def symbol_prefix_count(spark, d):
    return lookup.count_name_prefix(symbols(spark, d), "customer#00")


@query(VIEWS + "SELECT array_to_string(list_sort(list(q)),',') AS items, (SELECT count(DISTINCT qualified_name) FROM y WHERE name ILIKE 'customer#00%') AS total, count(*) AS returned, (SELECT count(DISTINCT qualified_name) FROM y WHERE name ILIKE 'customer#00%')>40 AS truncated FROM (SELECT DISTINCT qualified_name AS q FROM y WHERE name ILIKE 'customer#00%' ORDER BY 1 LIMIT 40)")
def capped_symbols(spark, d):
    got = lookup.capped_symbols(symbols(spark, d), "customer#00", 40)
    return got.withColumn("items", F.array_join("items", ","))


@query(VIEWS + "SELECT qualified_name, kind FROM y WHERE module='catalog'")
def symbols_of_module(spark, d):
    return lookup.by_module(symbols(spark, d), "catalog").select("qualified_name", "kind")


@query(VIEWS + MEMBERS + "SELECT qualified_name, line_start, visibility FROM m WHERE parent_fqn='catalog.part.P5'")
def symbols_by_parent(spark, d):
    got = lookup.by_parent(members(spark, d), "catalog.part.P5").select("qualified_name", "line_start", "visibility")
    return got.withColumn("line_start", F.col("line_start").cast("long"))


@query(VIEWS + MEMBERS + "SELECT qualified_name, module FROM y")
def all_types(spark, d):
    both = symbols(spark, d).unionByName(members(spark, d), allowMissingColumns=True)
    return lookup.all_types(both).select("qualified_name", "module")


@query(VIEWS + "SELECT qualified_name AS fqn, max(module) AS module FROM y GROUP BY 1")
def type_modules(spark, d):
    return lookup.type_to_module(symbols(spark, d))


@query(VIEWS + "SELECT source_fqn, target_fqn, kind, line FROM g WHERE source_fqn='sales.order.O7' UNION ALL SELECT source_fqn, target_fqn, kind, line FROM g WHERE target_fqn='geo.nation.N3' UNION ALL SELECT source_fqn, target_fqn, kind, line FROM g WHERE kind='EXTENDS'")
def edges_by_end_and_kind(spark, d):
    e = edges(spark, d)
    got = lookup.edges_of(e, source="sales.order.O7").unionByName(lookup.edges_of(e, target="geo.nation.N3")).unionByName(lookup.edges_of(e, kind="EXTENDS"))
    return got.select("source_fqn", "target_fqn", "kind", "line")


@query(VIEWS + "SELECT row_number() OVER (ORDER BY confidence DESC, line, source_fqn, target_fqn, caller_member) AS place, source_fqn, confidence FROM g WHERE kind='CALLS' AND split_part(target_fqn,'#',1)='catalog.part.P5' ORDER BY 1 LIMIT 20")
def caller_rows(spark, d):
    first = lookup.caller_rows(edges(spark, d), "catalog.part.P5").limit(20)
    rows = first.agg(F.collect_list(F.struct("confidence", "line", "source_fqn", "target_fqn", "caller_member")).alias("x"))  # 20 rows
    return rows.select(F.posexplode("x").alias("i", "r")).select((F.col("i") + 1).cast("long").alias("place"), "r.source_fqn", "r.confidence")


_CAPPED = """, near AS (SELECT DISTINCT {far} AS node FROM o WHERE kind='CALLS' AND {at}='{root}'), a AS (SELECT node FROM near UNION SELECT node FROM far WHERE node<>'{root}')
SELECT (SELECT array_to_string(list_sort(list(node)),',') FROM (SELECT node FROM a ORDER BY 1 LIMIT 30)) AS items, (SELECT count(*) FROM a) AS total, least(30,(SELECT count(*) FROM a)) AS returned, (SELECT count(*) FROM a)>30 AS truncated,
(SELECT count(*) FROM near) AS direct_total, (SELECT count(*) FROM far WHERE node<>'{root}') AS transitive_total"""


@query(VIEWS + _closure("far", ONE, CALL) + _CAPPED.format(far="s", at="t", root=ROOT))
def capped_caller_list(spark, d):
    return lookup.capped_neighbours(edges(spark, d), ROOT, True, 30).withColumn("items", F.array_join("items", ","))


@query(VIEWS + _closure("far", "SELECT 'sales.order.O7' AS root", CALL, False) + _CAPPED.format(far="t", at="s", root="sales.order.O7"))
def capped_callee_list(spark, d):
    return lookup.capped_neighbours(edges(spark, d), "sales.order.O7", False, 30).withColumn("items", F.array_join("items", ","))


@query(VIEWS + "SELECT array_to_string(list_sort(list(DISTINCT source_fqn)),',') AS items, count(DISTINCT source_fqn) AS total, count(DISTINCT source_fqn) AS returned, false AS truncated FROM g WHERE kind='TESTS' AND target_fqn='sales.customer.C7'")
def capped_test_list(spark, d):
    return lookup.capped_tests(edges(spark, d), "sales.customer.C7").withColumn("items", F.array_join("items", ","))


@query("SELECT DISTINCT coalesce(lang,'none') AS module FROM documents")
def modules_with_files(spark, d):
    return lookup.modules_with_files(table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("module")))


@query("SELECT 'doc'||doc_id AS path, sha256(coalesce(text,'')) AS hash FROM documents WHERE lang='de'")
def module_file_states(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("module"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return lookup.file_states(rows, "de")


@query("SELECT DISTINCT source AS module FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE lang='en' AND source IS NOT NULL AND doc_id%3=0)")
def deleted_modules(spark, d):
    docs = table(spark, d, "documents").where("source is not null").withColumn("module", F.col("source"))
    return lookup.deleted_modules(docs, docs.where("lang = 'en' and doc_id % 3 = 0"))


@query("SELECT vec_id, label, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),6) AS total FROM embeddings WHERE vec_id=7")
def embedding_by_key(spark, d):
    got = lookup.embedding_of(table(spark, d, "embeddings"), 7, "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.select("vec_id", "label", F.size("embedding").cast("long").alias("dimensions"), F.round(total, 6).alias("total"))


@query(VIEWS + "SELECT DISTINCT module, split_part(target_fqn,'#',1) AS symbol FROM g WHERE module='test' AND split_part(target_fqn,'#',1) NOT IN (SELECT qualified_name FROM y WHERE note IS NULL)")
def unresolved_symbols(spark, d):
    known = symbols(spark, d).where("size(annotations) = 0").select(F.col("qualified_name").alias("symbol"))
    lost = edges(spark, d).select("module", ids.owner(F.col("target_fqn")).alias("symbol")).distinct().join(known, "symbol", "left_anti")
    return lookup.unresolved_of(lost.withColumn("file_path", F.lit("")).withColumn("line", F.lit(0)), "test").select("module", "symbol")


@query(VIEWS + """, e AS (SELECT split_part(source_fqn,'#',1) AS source, split_part(target_fqn,'#',1) AS target, kind, line FROM g)
SELECT 'sales-must-not-use-geo' AS rule, source, target, min(line) AS line FROM e JOIN y a ON a.qualified_name=source JOIN y b ON b.qualified_name=target WHERE e.kind IN ('CALLS','USES') AND a.note IN ('Controller','Repository') AND regexp_matches(target,'^geo\\.') AND source IN (SELECT min(qualified_name) FROM y WHERE note='Controller') GROUP BY 1,2,3""")
def violations_of_symbol(spark, d):
    y = symbols(spark, d)
    first = y.where("array_contains(annotations, 'Controller')").agg(F.min("qualified_name")).first()[0]
    return lookup.violations_of(analyse.rule_violations(edges(spark, d), y, RULES), first or "")


@query(VIEWS + """, b AS (SELECT 'geo.nation.N'||n_nationkey||'#at'||r_regionkey AS target_fqn, CASE WHEN n_nationkey%3=0 THEN 'catalog.supplier.S'||n_nationkey ELSE 'app.nation'||n_nationkey END AS property_key FROM nation JOIN region ON n_regionkey=r_regionkey)
SELECT DISTINCT qualified_name AS root, property_key, target_fqn FROM b JOIN y ON qualified_name=split_part(target_fqn,'#',1) OR qualified_name=property_key""")
def config_impact(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    bindings = nation.select(F.concat(F.lit("geo.nation.N"), key, F.lit("#at"), F.col("n_regionkey").cast("string")).alias("target_fqn"),
                             F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("catalog.supplier.S"), key)).otherwise(F.concat(F.lit("app.nation"), key)).alias("property_key"))
    return lookup.config_impact(bindings, symbols(spark, d).select(F.col("qualified_name").alias("root")))


@query(VIEWS + "SELECT source_fqn, target_fqn, y.module FROM g JOIN y ON qualified_name=split_part(source_fqn,'#',1)")
def merge_attribution(spark, d):
    return lookup.attributed(edges(spark, d), symbols(spark, d)).select("source_fqn", "target_fqn", "module")


@query(VIEWS + MEMBERS + "SELECT file_path, array_to_string(list_sort(list(DISTINCT name)),',') AS methods FROM m WHERE visibility='PRIVATE' AND parent_fqn NOT IN (SELECT t FROM o WHERE kind='CALLS') GROUP BY 1")
def dead_private_methods(spark, d):
    return lookup.dead_private_methods(edges(spark, d), members(spark, d)).withColumn("methods", F.array_join("methods", ","))


@query(VIEWS + """, i AS (SELECT 'catalog.part.P'||p_partkey AS own, 'm1' AS old_name, CASE WHEN p_partkey%2=0 THEN 'm1' ELSE 'n'||p_size END AS new_name FROM part WHERE p_type='PROMO')
SELECT DISTINCT own||'#m1(int)' AS fqn, old_name, new_name, s AS caller, 'sales/order'||(CAST(regexp_extract(s,'O([0-9]+)$',1) AS BIGINT)%10)||'.java' AS caller_file FROM i JOIN o ON t=own AND kind='CALLS' WHERE starts_with(s,'sales.order.') AND old_name<>new_name""")
def migration_plan(spark, d):
    own = F.concat(F.lit("catalog.part.P"), F.col("p_partkey").cast("string"))
    hint = F.concat(own, F.lit("#"), F.when(F.col("p_partkey") % 2 == 0, "m1").otherwise(F.concat(F.lit("n"), F.col("p_size").cast("string"))))
    radar = table(spark, d, "part").where("p_type = 'PROMO'").select(F.concat(own, F.lit("#m1(int)")).alias("fqn"), hint.alias("replacement_hint"))
    return lookup.migration_plan(edges(spark, d), order_symbols(spark, d), radar)


@query("SELECT count(*) AS symbols, sum(p_size) AS direct_callers, sum(p_partkey) AS blast_radius, CAST(floor(avg(p_size*2)) AS INT) AS debt FROM part WHERE p_type='PROMO'")
def deprecation_totals(spark, d):
    rows = table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_size").alias("direct_callers"), F.col("p_partkey").alias("blast_radius"), (F.col("p_size") * 2).alias("effort"))
    return lookup.deprecation_totals(rows)


@query(VIEWS + MEMBERS + ", v AS (SELECT parent_fqn, count(DISTINCT visibility) AS n, min(visibility) AS v FROM m WHERE name IN ('m1','m5','o0') GROUP BY 1) SELECT qualified_name AS fqn, CASE WHEN n=1 THEN v.v WHEN kind='INTERFACE' THEN 'PUBLIC' ELSE 'PACKAGE' END AS visibility FROM y LEFT JOIN v ON parent_fqn=qualified_name")
def derived_visibility(spark, d):
    own = members(spark, d).select(F.col("parent_fqn").alias("fqn"), "visibility", (~F.col("name").isin("m1", "m5", "o0")).alias("synthetic"))
    return lookup.derived_visibility(symbols(spark, d).select(F.col("qualified_name").alias("fqn"), "kind"), own)


_CASES = """WITH c AS (SELECT o_orderpriority AS case_name, count(*) FILTER (WHERE o_orderkey%9<>0) AS matched, count(*) FILTER (WHERE o_orderkey%9=0) AS missed, count(*) FILTER (WHERE o_orderkey%20=0) AS spurious FROM orders GROUP BY 1),
s AS (SELECT *, round(matched/(matched+spurious),6) AS p, round(matched/(matched+missed),6) AS r FROM c)"""


@query(_CASES + " SELECT count(*) AS cases, count(*) FILTER (WHERE missed=0 AND spurious=0) AS perfect, round(avg(p),6) AS precision, round(avg(r),6) AS recall, round(avg(p),6)>=0.85 AND round(avg(r),6)>=0.9 AS passed FROM s")
def eval_summary(spark, d):
    n = lambda c: F.count_if(c)
    key = F.col("o_orderkey")
    cases = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("case_name")).agg(n(key % 9 != 0).alias("matched"), n(key % 9 == 0).alias("missed"), n(key % 20 == 0).alias("spurious"))
    cases = cases.withColumns({"precision": F.round(F.col("matched") / (F.col("matched") + F.col("spurious")), 6), "recall": F.round(F.col("matched") / (F.col("matched") + F.col("missed")), 6)})
    return lookup.evaluation_summary(cases).drop("summary")


@query("SELECT sha256('module'||p_partkey||'|false') AS key, 'lib'||p_size||'.jar' AS classpath FROM part WHERE p_partkey%4<>0 AND p_size%5<>0")
def classpath_cache(spark, d):
    key = lookup.cache_key(F.concat(F.lit("module"), F.col("p_partkey").cast("string")), F.lit(False))
    p = table(spark, d, "part").select(key.alias("key"), "p_partkey", "p_size")
    wanted = p.select("key", F.sha2(F.col("p_partkey").cast("string"), 256).alias("build_hash"))
    changed = F.when(F.col("p_partkey") % 4 == 0, "old").otherwise(F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("lib"), F.col("p_size").cast("string"), F.lit(".jar")))
    return lookup.cache_hits(wanted, p.select("key", F.sha2(changed, 256).alias("build_hash"), text.alias("classpath")))


@query(VIEWS + """, u(node) AS (SELECT DISTINCT s FROM o WHERE t='sales.customer.C7' AND s<>t UNION SELECT o.s FROM u JOIN o ON o.t=u.node AND o.s<>o.t) SELECT node FROM u WHERE node<>'sales.customer.C7'""")
def untyped_reach(spark, d):
    e = edges(spark, d)
    return traverse.reach(e, traverse.roots_of(e, "sales.customer.C7"), None, True).select("node")


@query(_TRADE + """, w(path) AS (SELECT [src, dst] FROM p WHERE src<dst
 UNION ALL SELECT list_append(path, dst) FROM w JOIN p ON p.src=path[-1] WHERE dst>path[1] AND NOT list_contains(path, dst)),
f AS (SELECT min(path) AS path FROM w JOIN p ON p.src=path[-1] AND p.dst=path[1] GROUP BY list_sort(path))
SELECT array_to_string(path,' ') AS cycle, len(path) AS length, array_to_string(list_transform(list_zip(path, list_append(path[2:], path[1])), lambda x: 'pkg.'||x[1]||'.T -> pkg.'||x[2]||'.T [USES]'),'; ') AS samples FROM f ORDER BY len(path), path LIMIT 100""")
def package_cycles(spark, d):
    name = lambda c: F.concat(F.lit("pkg."), c, F.lit(".T"))
    e = _trade(spark, d).select(name(F.col("src")).alias("source_fqn"), name(F.col("dst")).alias("target_fqn"), F.lit("USES").alias("kind"), F.lit("POSSIBLE").alias("confidence"))
    got = traverse.package_cycles(e)
    return got.select(F.array_join(F.transform("path", lambda x: F.substring_index(x, ".", -1)), " ").alias("cycle"), F.col("length").cast("long").alias("length"), F.array_join("sample_edges", "; ").alias("samples"))


@query("SELECT url, NOT regexp_matches('/'||regexp_replace(url,'^[a-z]+://',''),'/(build|target|out|node_modules|dist|bin|\\.[^/.][^/]*)/') AND regexp_matches(url,'\\.(java|kt|ts|tsx|js|jsx|py|go|yml|yaml|properties)$') AS watched, NOT contains(url,'://') AS inside FROM pages")
def path_checks(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("url", guards.watched(F.regexp_replace("url", "^[a-z]+://", "")).alias("watched"), guards.stays_inside(F.col("url")).alias("inside"))


@query("""SELECT doc_id, length(text)>0 AND NOT regexp_matches(text,'[\\x00-\\x1f\\x7f]') AS safe, replace(replace(replace(source,':','_'),'/','_'),'\\','_') AS partition, lower(lang) AS label,
 CASE WHEN doc_id%2=0 THEN 'org'||doc_id||'/repo' END AS slug, left(sha256(coalesce(lang,'')),16) AS signature FROM documents WHERE text IS NOT NULL""")
def name_checks(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    key = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("git@github.com:org"), key, F.lit("/repo.git"))).otherwise(F.concat(F.lit("https://example.org/"), key))
    return docs.select("doc_id", guards.safe_argument(F.col("text")).alias("safe"), guards.partition_name(F.col("source")).alias("partition"), guards.kind_label(F.col("lang")).alias("label"),
                       guards.repo_slug(url).alias("slug"), ids.signature_hash(F.coalesce("lang", F.lit(""))).alias("signature"))


@query("SELECT doc_id, left(trim(translate(regexp_replace(text,'[\\x00-\\x1f\\x7f]',' ','g'),'`|<>','''/()'),' '),200) AS safe FROM documents WHERE text IS NOT NULL")
def markdown_safe(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", ids.markdown_safe(F.col("text")).alias("safe"))


@query("SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'app.key'||o_custkey END AS placeholder, CASE o_orderkey%3 WHEN 0 THEN '17' WHEN 1 THEN 'UNKNOWN' ELSE '21' END AS jdk, 'order-'||o_orderkey||'-of-c'||o_custkey AS slug, CASE o_orderkey%4 WHEN 0 THEN 'New'||o_custkey WHEN 1 THEN 'a.B#c'||o_custkey WHEN 2 THEN 'See'||o_custkey END AS hint FROM orders")
def text_functions(spark, d):
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = F.when(key % 5 == 0, F.concat(F.lit("${app.key"), cust, F.lit(":none}"))).otherwise(F.concat(F.lit("plain "), cust))
    version = F.element_at(F.array(F.lit("17.0.2"), F.lit("1.8"), F.lit("openjdk 21")), (key % 3 + 1).cast("int"))
    title = F.concat(F.lit("Order: "), key.cast("string"), F.lit(" (of C"), cust, F.lit(")"))
    notes = F.when(key % 4 == 0, F.array(F.lit("Old"), F.concat(F.lit('Deprecated("x", replaceWith = ReplaceWith("New'), cust, F.lit('"))')))).when(key % 4 == 1, F.array(F.concat(F.lit("use a.B#c"), cust, F.lit(" instead")))).otherwise(F.array(F.lit("Deprecated")))
    doc = F.when(key % 4 == 2, F.concat(F.lit("Gone. @see See"), cust)).when(key % 4 == 3, "nothing said").otherwise("@see Else")
    return o.select("o_orderkey", ids.placeholder_key(value).alias("placeholder"), ids.jdk_major(version).alias("jdk"), ids.slug(title).alias("slug"), ids.replacement_hint(notes, doc).alias("hint"))


@query(VIEWS + "SELECT source_fqn, target_fqn, kind, line, caller_member, module, max(confidence) AS confidence FROM g WHERE module IN ('geo','catalog') GROUP BY ALL")
def store_merge(spark, d):
    e = edges(spark, d).where("module in ('geo', 'catalog')")
    return store.merge_stores(e.where("module = 'geo'"), e.where("module = 'catalog'"), e.where("kind = 'EXTENDS'"))
