"""Quality rules: base counts of a text, and robust multivariate outliers, in DataFrame operations only.

Base counts take words [^\\x20\\x09-\\x0D]+. A document fails the base rules with under ``min_words`` words or
with more than half of its words in 3-word windows found twice or more in it.

The others are judged by language and source. Their statistics become a vector of five: log of the words, mean
word length, and square roots of the rates of symbols, of repeated lines and of repeated words. Each group's
centre and scatter are minimum-covariance-determinant estimates: two deterministic starts (medians with
median absolute deviations; mean and covariance) each take concentration steps - keep the three quarters of the
group nearest by Mahalanobis distance, estimate anew - and the smaller determinant wins, followed by the usual
reweighting. The share to keep is cut from a histogram of log distances over all rows of the group (a step
of 1/32 octave), so nothing is sorted and no group meets in one task. Rows whose distance passes the
chi-square quantile 1 - ``tail`` go. The scatter's diagonal has a floor (``FLOOR`` squared) per
statistic, so that a group whose members agree exactly doesn't reject the next best text.

Every (language, source) group is fitted, whatever its size, and so are every language and the whole table. A group's
centre and scatter are drawn toward its language's as if it held ``PRIOR`` rows more of these, and the language's in the
same way toward the whole table's. So small groups lean on their language, large ones stand for themselves, nothing switches at a
size, and every row that passes the base rules gets a distance. The distance of the centres doesn't widen the scatter: rows that are
alone in their source, or a few of one kind, are as far from their language as they would be in another source of it.

Estimates meet their rows by a broadcast where the counted groups are at most ``BROADCAST``. Beyond that the groups of more than
1/BROADCAST of all rows, of which there can't be more than BROADCAST, are broadcast and the others joined by key.

Null language or source: a value of its own. Null text: no words. Null doc_id and repeated rows: each row is judged.
Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import WHITE, WHITE_CHARS, materialize, rows_of, with_row

P = 5
X = [f"x{i}" for i in range(P)]
#: Least spread of each statistic: log words, word length, square roots of symbol, line and word rates.
FLOOR = (0.25, 0.5, 0.12, 0.15, 0.15)
#: Rows' weight of the wider group's estimate in a group's own.
PRIOR = 30
#: Groups whose estimates (a row of some 200 bytes each) are broadcast at most.
BROADCAST = 20_000


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the nearest share of a normal sample is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows are compared by 64-bit hash."""
    def count(w):
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

        def twice(s):
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return let(F.array_sort(F.transform(again, lambda x: x["i"])), covered)

        return let(windows, twice)

    def covered(at):
        step = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda s, x: s + x)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w)))


def base_statistics(docs: DataFrame, min_words: int = 50, extra: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    words = words_of(text)
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in extra],
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", *extra, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return dict(zip(X, (F.log(n), chars / n, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n))))


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
AT = {p: k for k, p in enumerate(PAIRS)}


def cholesky(cov: Column) -> Column:
    """The lower factor of a covariance, both as arrays by rows."""
    def column(j, c, done):
        """The factor's column j from the earlier ones; done has them as arrays of P."""
        def dot(i):
            out = c[AT[i, j]]
            for d in done:
                out = out - d[i] * d[j]
            return out

        root = F.sqrt(F.greatest(dot(j), F.lit(1e-12)))
        own = let(root, lambda r: F.array(*[F.lit(0.0) if i < j else r if i == j else dot(i) / r for i in range(P)]))
        if j == P - 1:
            return let(own, lambda d: F.array(*[[*done, d][k][i] for i, k in PAIRS]))
        return let(own, lambda d: column(j + 1, c, [*done, d]))

    return let(cov, lambda c: column(0, c, []))


def _scatter(rows: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean (m), covariance times factor (c, by rows), its lower Cholesky factor (l) and log determinant of each group."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS])
    mean = [F.col(f"s_{x}") / F.col("n") for x in X]

    def covariance(i, j):
        own = F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]
        return F.greatest(own, F.lit(0.0)) * factor + FLOOR[i] ** 2 if i == j else own * factor

    out = sums.select(*by, "n", F.array(*mean).alias("m"), F.array(*[covariance(i, j) for i, j in PAIRS]).alias("c")).withColumn("l", cholesky(F.col("c")))
    return out.withColumn("logdet", sum((F.log(F.col("l")[AT[i, i]]) for i in range(P)), F.lit(0.0)))


def _distance() -> Column:
    z, k = [], 0
    for i in range(P):
        rest = F.col(X[i]) - F.col("m")[i]
        for j in range(i):
            rest = rest - F.col("l")[k + j] * z[j]
        z.append(rest / F.col("l")[k + i])
        k += i + 1
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _bin(d: Column) -> Column:
    return F.floor(32 * F.log2(d + F.lit(1e-6))).cast("int")


def _meet(rows: DataFrame, estimates: DataFrame, heavy: DataFrame | None, on=("gid",)) -> DataFrame:
    """rows with their group's estimates (one or two a group). heavy: the groups whose estimates are broadcast; None: all of them."""
    if heavy is None:
        return rows.join(F.broadcast(estimates), list(on))
    large = F.broadcast(estimates.join(F.broadcast(heavy), list(on), "left_semi"))
    small = rows.join(F.broadcast(heavy), list(on), "left_anti")
    return rows.join(large, list(on)).unionByName(small.join(estimates.hint("shuffle_hash"), list(on)))


def _heavy(sizes: DataFrame, on=("gid",), limit: int | None = None) -> DataFrame | None:
    """sizes: group keys and n. Groups that hold over 1/limit of the rows, if there are over limit groups; else None."""
    limit = limit or BROADCAST
    groups, total = sizes.agg(F.count("*"), F.sum("n")).first()
    return None if groups <= limit else materialize(sizes.where(F.col("n") > total / limit).select(*on), "mcd-heavy")


def fit(rows: DataFrame, share: float = 0.75, steps: int = 3, limit: int | None = None) -> DataFrame:
    """rows: gid and the statistics. Returns gid, n (rows of the group), m, c, l."""
    middle = rows.groupBy("gid").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 10_000).alias(f"c_{x}") for x in X])
    middle = materialize(middle, "mcd-middle")
    heavy = _heavy(middle, limit=limit)
    off = _meet(rows, middle, heavy).groupBy("gid").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"c_{x}")), 0.5, 10_000).alias(f"a_{x}") for x in X])
    diagonal = [[F.lit(0.0)] * i + [F.greatest(1.4826 * F.col(f"a_{X[i]}"), F.lit(FLOOR[i]))] for i in range(P)]
    centre = F.array(*[F.col(f"c_{x}") for x in X])
    robust = middle.join(off, "gid").select("gid", F.lit(0).alias("start"), centre.alias("m"), F.array(*[x for row in diagonal for x in row]).alias("l"))
    plain = _scatter(rows, ["gid"], 1.0).select("gid", F.lit(1).alias("start"), "m", "l")
    now = materialize(robust.unionByName(plain), "mcd-starts")
    by = ["gid", "start"]
    for _ in range(steps):
        far = _meet(rows, now, heavy).withColumn("bin", _bin(_distance()))
        counted = far.groupBy(*by, "bin").agg(F.count("*").alias("k"))
        upto = counted.withColumn("upto", F.sum("k").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("all", F.sum("k").over(Window.partitionBy(*by)))
        cut = upto.where(F.col("upto") >= F.floor(share * F.col("all"))).groupBy(*by).agg(F.min("bin").alias("cut"))
        cut = now.join(materialize(cut, "mcd-cut"), by)
        near = _meet(rows, cut, heavy).where(_bin(_distance()) <= F.col("cut"))
        now = materialize(_scatter(near, by, consistency(share)).select(*by, "m", "c", "l", "logdet"), "mcd-step")
    best = now.groupBy("gid").agg(F.min(F.struct("logdet", "start", "m", "c", "l")).alias("b")).select("gid", "b.m", "b.c", "b.l")
    best = materialize(best, "mcd-best")
    near = _meet(rows, best, heavy).where(_distance() <= chi2_quantile(0.975, P))
    last = _scatter(near, ["gid"], consistency(0.975)).select("gid", F.col("m").alias("m1"), F.col("c").alias("c1"), F.col("l").alias("l1"))
    out = middle.select("gid", "n").join(best, "gid").join(last, "gid", "left")
    return materialize(out.select("gid", "n", *[F.coalesce(f"{x}1", x).alias(x) for x in "mcl"]), "mcd-final")


def _drawn(own: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """own (n, m, c) drawn toward wide (its m and c, found by key), as if it held PRIOR rows of the latter."""
    met = own.join(wide.select(F.col("gid").alias(key), F.col("m").alias("wm"), F.col("c").alias("wc")), key)
    n, k = F.col("n").cast("double"), F.lit(float(PRIOR))
    mean = F.array(*[(n * F.col("m")[i] + k * F.col("wm")[i]) / (n + k) for i in range(P)])
    cov = F.array(*[(n * F.col("c")[a] + k * F.col("wc")[a]) / (n + k) for a in range(len(PAIRS))])
    return met.withColumns({"m": mean, "c": cov}).drop("wm", "wc")


def judge(docs: DataFrame, min_words: int = 50, tail: float = 1e-4, keys: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (null where the base rules failed) and kept of each row; keys: columns to carry."""
    rows = base_statistics(docs, min_words, ("lang", "source", *keys)).withColumns(vector())
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    by_lang = F.xxhash64(F.lit(1), lang.isNull(), lang)
    by_both = F.xxhash64(F.lit(2), lang.isNull(), lang, source.isNull(), source)
    rows = materialize(rows.withColumns({"gid": by_both, "_lang_gid": by_lang}).drop("lang", "source"), "quality-statistics")
    passed = rows.where("not base_failed")
    levels = passed.select(F.explode(F.array(F.col("gid"), F.col("_lang_gid"), F.lit(0).cast("long"))).alias("gid"), *X)
    fitted = fit(levels, limit=limit)
    every, langs = fitted.where("gid = 0"), passed.select("gid", "_lang_gid").distinct()
    of_lang = fitted.join(langs.select("_lang_gid").distinct(), F.col("gid") == F.col("_lang_gid")).drop("_lang_gid").withColumn("_all", F.lit(0).cast("long"))
    of_lang = _drawn(of_lang, every, "_all").drop("_all")
    final = _drawn(fitted.join(langs, "gid"), of_lang, "_lang_gid").select("gid", "n", "m", cholesky(F.col("c")).alias("l"))
    final = materialize(final, "quality-estimates")
    judged = _meet(passed, final.drop("n"), _heavy(final.select("gid", "n"), limit=limit))
    distance = F.sqrt(_distance())
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    verdict = distance <= math.sqrt(chi2_quantile(1 - tail, P))
    good = judged.select("doc_id", *keys, *counts, verdict.alias("kept"), distance.alias("distance"))
    failed = rows.where("base_failed").select("doc_id", *keys, *counts, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.unionByName(failed)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, columns as they were."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select("doc_id", "text", "lang", "source", th.alias("_weft_th"))
    good = judge(keyed, keys=("_weft_th",), **options).where("kept").select(F.col("doc_id").alias("good_id"), F.col("_weft_th").alias("good_th")).distinct()
    marked = with_row(docs, own_id=F.col("doc_id").cast("long"), own_th=th)
    same = F.col("own_id").eqNullSafe(F.col("good_id")) & (F.col("own_th") == F.col("good_th"))
    return rows_of(marked.join(good, same, "left_semi"), docs.columns)
