"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Base statistics of whole texts, then per (lang, source) group the mean and
covariance of the transformed statistics over the most central ``share`` of
the group's rows. Concentration steps find them: distances under the present
estimate, their exact quantile (on a fixed grid of logarithms, so that its
memory is bounded and its value does not depend on task order), and estimates
over the rows within it. Two starts are followed for ``steps`` steps (one from
medians and spreads, one from the plain mean), the one with the lower
determinant is kept, group by group (both go through the same passes), and steps go on from there until no
group's determinant falls any more. Covariances are then scaled to be
consistent for normal rows, and a row is rejected when its squared Mahalanobis
distance exceeds the chi-square quantile of ``level``.

Everything on the main path is a DataFrame operation: map-side combined
aggregates, joins with the group table and closed-form linear algebra in
columns. A group table of up to ``sent_groups`` rows, which is counted first,
goes to every task; a larger one is repeated for SALTS salts and joined on
group and salt, so that a hot group is never one task's.

Defined cases: a null text has no words and no lines, so it fails the base
rules; null lang and null source are values of their own; groups of fewer than
``least_rows`` rows that pass the base rules share one estimate per lang, and
where that has too few rows still, the base rules alone decide; a statistic
that does not vary over ``share`` of a group's rows (by TINY or less) gets the
floor of its scale there, and no other does; very long texts are read whole;
repeated rows and ties of a distance share a verdict; other columns, of any
name, are not read; an empty table stays empty.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import cut

#: White space and symbols of the base statistics.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Parts that a group's rows are dealt into where the group table is too large to be sent.
SALTS = 32

#: Scale of each transformed statistic where it does not vary: differences below it are not held against a row.
FLOORS = {"v_words": 0.6, "v_chars": 0.35, "v_symbols": 0.1, "v_lines": 0.1, "v_repeats": 0.1}
STATS = list(FLOORS)
#: A statistic whose shortest interval with ``share`` of a group's rows is no longer than this does not vary there.
TINY = 1e-3
#: Least fall of a log determinant that asks for another step.
FALL = 1e-9


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters that are not ASCII white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def with_repeat_words(docs: DataFrame, words: str) -> DataFrame:
    """``docs`` with n_repeat_words: words in an 8-word window found twice or more in the text.

    Each step is a column of its own, so that nothing is computed twice; only
    texts with a repeated window take the steps that need sorting.
    """
    n = F.size("_h") - WINDOW + 1
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = docs.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    out = out.withColumn("_w", F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    same = F.zip_with(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 2, F.size("_s")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(
        F.array_sort(F.array_distinct(F.flatten(same))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    return out.withColumn("n_repeat_words", covered).drop("_h", "_w", "_s")


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    out = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    held = F.coalesce(F.col(text), F.lit(""))
    out = with_repeat_words(out, "_words").withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(held, SPACE, "")).cast("long"),
            "n_symbols": (F.length(held) - F.length(F.translate(held, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    return out.drop("_words", "_lines").withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def transformed() -> dict[str, Column]:
    """Statistics brought to comparable, roughly symmetric scales."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "v_words": F.log(words),
        "v_chars": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words) * 2,
        "v_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "v_lines": F.log1p("n_dup_lines") / 4,
        "v_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(STATS) for b in STATS[: i + 1]]


def met_groups(rows: DataFrame, groups: DataFrame, key: str, sent: bool, how: str = "inner") -> DataFrame:
    """``rows`` (with _salt) with the columns of their group's one row of ``groups``."""
    if sent:
        return rows.join(F.broadcast(groups), key, how)
    return rows.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], how)


def at_most(df: DataFrame, n: int) -> bool:
    return df.limit(n + 1).count() <= n


def chi_square(x: float, k: int) -> float:
    """P(X <= x) for a chi-square of an odd number ``k`` of degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erf(math.sqrt(x / 2))
    for i in range(1, k, 2):
        total -= term
        term *= x / (i + 2)
    return total


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < share else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the ``share`` most central normal rows is multiplied by to be that of all."""
    k = len(STATS)
    return share / chi_square(chi_square_quantile(share, k), k + 2)


def floored(rows: DataFrame, share: float) -> DataFrame:
    """Per group f_*: the floor's square where a statistic does not vary over ``share`` of the rows, else 0."""
    at = [i * (1 - share) / 10 for i in range(11)]
    held = rows.groupBy("group").agg(*[F.expr(f"percentile(cast(round({a} * 10000) as long), array({', '.join(map(str, [*at, *[x + share for x in at]]))}))").alias(f"q_{a}") for a in STATS])
    width = lambda a: F.least(*[F.col(f"q_{a}")[11 + i] - F.col(f"q_{a}")[i] for i in range(11)]) / 10000
    return held.select("group", *[F.when(width(a) <= TINY, F.lit(FLOORS[a] ** 2)).otherwise(F.lit(0.0)).alias(f"f_{a}") for a in STATS])


def moments(rows: DataFrame, keep: Column, floors: DataFrame | None = None) -> DataFrame:
    """Per group: means m_* and covariances c_* of the rows to keep, with FLOORS or the group's own ``floors`` on the diagonal."""
    on = lambda x: F.when(keep, x)
    sums = [F.avg(on(F.col(a))).alias(f"m_{a}") for a in STATS] + [F.avg(on(F.col(a) * F.col(b))).alias(f"e_{a}_{b}") for a, b in pairs()]
    held = rows.groupBy("group").agg(*sums)
    floor = lambda a: F.lit(FLOORS[a] ** 2) if floors is None else F.col(f"f_{a}")
    if floors is not None:
        held = held.join(floors, "group")
    cov = [(F.col(f"e_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}") + (floor(a) if a == b else F.lit(0.0))).alias(f"c_{a}_{b}") for a, b in pairs()]
    return factored(held.select("group", *[f"m_{a}" for a in STATS], *cov))


def factored(groups: DataFrame) -> DataFrame:
    """Cholesky factor l_* of each covariance, and its log determinant. Floors keep every pivot positive."""
    for i, a in enumerate(STATS):
        for j, b in enumerate(STATS[: i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for k in STATS[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            groups = groups.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if a == b else rest / F.col(f"l_{b}_{b}"))
    return groups.withColumn("log_det", sum((2 * F.log(f"l_{a}_{a}") for a in STATS), F.lit(0.0))).drop(*[f"c_{a}_{b}" for a, b in pairs()])


def with_distance(rows: DataFrame, estimates: DataFrame, name: str, sent: bool) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance under their group's estimate."""
    met = met_groups(rows, estimates, "group", sent, "left")
    total = F.lit(0.0)
    for i, a in enumerate(STATS):
        rest = F.col(a) - F.col(f"m_{a}")
        for b in STATS[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"_y_{b}")
        met = met.withColumn(f"_y_{a}", rest / F.col(f"l_{a}_{a}"))
        total = total + F.col(f"_y_{a}") * F.col(f"_y_{a}")
    return met.withColumn(name, total).select(*rows.columns, name)


def grid(distance: Column) -> Column:
    """A distance on a fixed logarithmic grid."""
    return F.floor(F.log(distance + 1e-6) * 64).cast("long")


def concentrate(rows: DataFrame, estimates: DataFrame, share: float, sent: bool, floors: DataFrame | None = None) -> DataFrame:
    """One concentration step: estimates over the ``share`` of each group that is nearest under ``estimates``."""
    near = with_distance(rows, estimates, "_d", sent).withColumn("_g", grid(F.col("_d")))
    limits = near.groupBy("group").agg(F.expr(f"percentile_disc({share}) within group (order by _g)").alias("_limit"))
    return moments(met_groups(near, limits, "group", sent), F.col("_g") <= F.col("_limit"), floors)


def spread_start(rows: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Start from medians and interquartile ranges, statistic by statistic."""
    steps = 1000
    pick = [F.expr(f"percentile(cast(round({a} * {steps}) as long), array(0.25, 0.5, 0.75))").alias(f"q_{a}") for a in STATS]
    held = rows.groupBy("group").agg(*pick)
    at = lambda a, k: F.col(f"q_{a}")[k] / steps
    mean = [at(a, 1).alias(f"m_{a}") for a in STATS]
    if floors is not None:
        held = held.join(floors, "group")
    floor = lambda a: F.lit(FLOORS[a] ** 2) if floors is None else F.greatest(F.col(f"f_{a}"), F.lit(TINY**2))
    cov = [(F.pow((at(a, 2) - at(a, 0)) / 1.349, F.lit(2.0)) + floor(a) if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in pairs()]
    return factored(held.select("group", *mean, *cov))


def robust_estimates(rows: DataFrame, share: float, steps: int, sent: bool = True, floors: DataFrame | None = None) -> DataFrame:
    """The estimate of the lower determinant of two starts, per group. Both are followed in the same passes, as groups of their own."""
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    named = lambda df, start: df.withColumn("start", start).withColumn("group", F.struct("group", "start")).drop("start")
    rows2, floors2 = named(rows, both), None if floors is None else named(floors, both)
    found = named(spread_start(rows, floors), F.lit(0)).unionByName(named(moments(rows, F.lit(True), floors), F.lit(1)))
    for _ in range(steps):
        found = cut(concentrate(rows2, found, share, sent, floors2))
    return lower(found.withColumn("group", F.col("group.group")))


def lower(estimates: DataFrame) -> DataFrame:
    """Of each group's estimates the one of the lower determinant."""
    best = estimates.groupBy("group").agg(F.min_by(F.struct(*[c for c in estimates.columns if c != "group"]), "log_det").alias("e"))
    return best.select("group", "e.*")


def converged(rows: DataFrame, estimates: DataFrame, share: float, sent: bool, floors: DataFrame) -> DataFrame:
    """``estimates`` after as many steps as lower a group's determinant; groups that are done take no further ones."""
    done, going = [], cut(estimates)
    while True:
        after = concentrate(met_groups(rows, going.select("group"), "group", sent), going, share, sent, floors)
        was = going.select("group", F.col("log_det").alias("_was"))
        after = cut(after.join(was, "group").withColumn("_falls", F.col("log_det") < F.col("_was") - FALL))
        still = after.where("_falls").drop("_was", "_falls")
        done.append(going.join(F.broadcast(still.select("group")) if sent else still.select("group"), "group", "left_anti"))
        if still.isEmpty():
            return cut(reduce(DataFrame.unionByName, done))
        going = still


def quality_rules(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = 0.75, steps: int = 2, least_rows: int = 50, level: float = 0.999, sent_groups: int = 10_000) -> DataFrame:
    """One row for each row: id, the base statistics, base_failed, distance and kept."""
    slim = docs.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    slim = base_statistics(slim).drop("text").withColumns(transformed())
    slim = cut(slim.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *STATS), F.lit(SALTS)).cast("int")))
    passed = ~F.col("base_failed")
    own = F.struct(F.col("lang").alias("lang"), F.col("source").alias("source"), F.lit(True).alias("own"))
    pool = F.struct(F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("own"))
    sizes = cut(slim.where(passed).groupBy(own.alias("own_group")).count().where(F.col("count") >= least_rows).select("own_group"))
    keyed = met_groups(slim.withColumn("own_group", own), sizes.withColumn("large", F.lit(True)), "own_group", at_most(sizes, sent_groups), "left")
    keyed = keyed.withColumn("group", F.when(F.col("large"), F.col("own_group")).otherwise(pool)).drop("own_group", "large", "lang", "source")
    rows = keyed.where(passed).select("group", "_salt", *STATS)
    enough = cut(rows.groupBy("group").count().where(F.col("count") >= least_rows).select("group"))
    sent = at_most(enough, sent_groups)
    met = met_groups(rows, enough, "group", sent)
    floors = cut(floored(met, share))
    estimates = converged(met, robust_estimates(met, share, steps, sent, floors), share, sent, floors)
    judged = with_distance(keyed, estimates, "distance", sent).withColumn("distance", F.col("distance") / consistency(share))
    kept = passed & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square_quantile(level, len(STATS)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
