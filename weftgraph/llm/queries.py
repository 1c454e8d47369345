"""The queries op1_ to op13_ over the whole documents or embeddings table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.simhash import near_duplicates

    got = near_duplicates(documents(spark, sf_dir), words_per_shingle=3, max_distance=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.outliers import judge

    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.lines import line_digest

    return line_digest(documents(spark, sf_dir), min_docs=10)


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.mixture import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")




def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.token_files import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.importance import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.spotsigs import near_documents

    return near_documents(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.chaining import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.merkle import manifest

    return manifest(documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.lloyd import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), clusters=40, rounds=5, seed="2:")


QUERIES = {f.__name__: f for f in (op1_tokens, op2_importance, op3_spotsigs, op4_simhash, op5_outliers, op6_packing, op7_lines, op8_mixture, op9_licenses, op10_passages, op11_token_counts, op12_manifest, op13_clusters)}


def _manifest_sql() -> str:
    """Levels by recursion: nodes of each group until one is left, then of the groups' roots; each document's way up along them."""
    fields = lambda more: " || ".join(
        f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in ("doc_id", "source", "lang", f"n_chars + {more}", "text"))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295)"
    up = lambda name, first: f"""{name} AS (SELECT 0 AS lv, {first}
 UNION ALL SELECT lv + 1, g, i // 2, sha256(string_agg(node, '' ORDER BY i)), max(n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lv, g, i // 2)"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({fields(0)}) AS leaf, CASE WHEN {crc} % 7 = 0 THEN sha256({fields(1)}) END AS other FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{up("low", "g, i, leaf AS node, n FROM p")},
sub AS MATERIALIZED (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS top, count(*) OVER () AS n, max(lv) OVER (PARTITION BY g) AS lv FROM low WHERE n = 1),
{up("high", "'' AS g, top AS i, subroot AS node, n FROM sub")},
nodes AS MATERIALIZED (SELECT lv, g, i, node FROM low UNION ALL SELECT lv + 1000, g, i, node FROM high),
ways AS (SELECT p.doc_id, p.g, p.leaf, coalesce(p.other, p.leaf) AS cur, 0 AS lv, p.i, p.n, sub.lv AS last, sub.subroot, sub.top, sub.n AS tops, '' AS proof FROM p JOIN sub USING (g)
 UNION ALL SELECT doc_id, w.g, leaf, CASE WHEN w.n = 1 THEN cur WHEN s.node IS NULL THEN sha256(cur) WHEN w.i % 2 = 0 THEN sha256(cur || s.node) ELSE sha256(s.node || cur) END,
  CASE WHEN w.n = 1 THEN 1000 ELSE w.lv + 1 END, CASE WHEN w.n = 1 THEN top ELSE w.i // 2 END, CASE WHEN w.n = 1 THEN tops ELSE (w.n + 1) // 2 END, last, subroot, top, tops, CASE WHEN w.n = 1 THEN proof ELSE proof || coalesce(s.node, '') END
  FROM ways w LEFT JOIN nodes s ON s.lv = w.lv AND s.g = CASE WHEN w.lv < 1000 THEN w.g ELSE '' END AND s.i = xor(w.i, 1) AND w.n > 1 WHERE NOT (w.lv >= 1000 AND w.n = 1))
SELECT doc_id, leaf, subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT node FROM high WHERE n = 1) AS verified FROM ways WHERE lv >= 1000 AND n = 1"""


def _clusters_sql(clusters: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Rounds written out: squared distances to every centroid, the least number among the nearest, floors of means."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS k, v AS c FROM v QUALIFY k < {clusters})"]
    nearest = "SELECT v.vec_id, v.v, min({{'d': list_sum(list_transform(range(1, %d), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT, 'k': c.k}}) AS b FROM v, c{n} c GROUP BY v.vec_id, v.v" % (dims + 1)
    for n in range(rounds):
        parts += [f"a{n} AS MATERIALIZED ({nearest.format(n=n)})",
                  f"m{n} AS (SELECT k, list(f ORDER BY i) AS c FROM (SELECT b.k AS k, i, floor(sum(v[i]) / count(*))::BIGINT AS f FROM a{n}, range(1, {dims + 1}) r(i) GROUP BY b.k, i) GROUP BY k)",
                  f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (k))"]
    return "WITH " + ",\n".join([*parts, f"e AS MATERIALIZED ({nearest.format(n=rounds)})"]) + f"""
SELECT vec_id, b.k AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM e JOIN c{rounds} c ON c.k = e.b.k"""


SQL: dict[str, str] = {
    "op7_lines": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''),chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''),chr(10)),1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key<>'' GROUP BY key HAVING count(DISTINCT doc_id)>=10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL),'')) AS kept_sha256 FROM k LEFT JOIN f ON f.key=k.key GROUP BY doc_id""",
    "op12_manifest": _manifest_sql(),
    "op13_clusters": _clusters_sql(),
}
