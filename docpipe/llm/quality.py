"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each document gives a vector of transformed statistics.  For every language and
source the minimum covariance determinant is sought from four deterministic
starts: medians with absolute deviations, plain moments, correlations of squashed
scores, and spatial signs.  A concentration step keeps the share ``SUPPORT`` of
rows with the smallest distances, takes their mean and covariance, and measures
all rows by them.  Every start takes ``TRIAL_STEPS``; the one with the smallest
determinant goes on until its determinant falls no further.  Distances and
medians are ranked through fixed bins, so every step is a partially aggregated
count or sum: a group that holds a third of all rows costs its tasks no more
than any other, and nothing is collected.

An estimate of five dimensions needs ``MIN_ROWS`` rows.  Groups with fewer are
judged with the other small sources of their language, and where those are too
few, with what other languages have left over.  Only if all that is left over in
the whole input is fewer than ``MIN_ROWS`` rows, no row of it is an outlier.

Estimates are a row for each language and source.  To drop rows they are sent to
where the rows lie: texts are measured twice, but neither moved nor written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stash

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUPPORT = 0.75
#: Concentration steps of every start, and of the best start at most.
TRIAL_STEPS = 2
STEPS = 40
#: Chance at which a row of a normal population would be rejected.
ALPHA = 1e-9
#: Smallest standard deviation that a transformed statistic is granted.
FLOORS = (0.25, 0.05, 0.35, 0.15, 0.15)
_P = len(FLOORS)
#: Rows that an estimate needs, five for each dimension.
MIN_ROWS = 5 * _P
#: Languages with sources, of some 250 bytes each, whose estimates are broadcast; more are joined as Spark sees fit.
BROADCAST_SOURCES = 20_000
_BINS_PER_UNIT = 128
_BLANKS = " \t\n\x0b\x0c\r"
_X = [f"x{i}" for i in range(_P)]
_M = [f"m{i}" for i in range(_P)]
_PAIRS = [(i, k) for i in range(_P) for k in range(i + 1)]
_W = [f"w{i}{k}" for i, k in _PAIRS]


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for the row."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(words: Column) -> Column:
    """Words within windows of ``WINDOW`` words that stand twice or more.

    Windows are compared by 64-bit hashes.  Only a text with a repeated window
    sorts its windows; a covered stretch is the sum of its steps, each at most
    one window long.
    """

    def count(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def covered(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ordered, i - 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

        return _bind(F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"])), count)

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _bind(F.array_sort(pairs), covered)
        )

    def of_words(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1))
        return F.when(F.size(hashed) <= WINDOW, F.lit(0).cast("long")).otherwise(
            _bind(F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, WINDOW))), of_windows)
        )

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    return F.struct(
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("w"),
        F.char_length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))).alias("l"),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics and the base rule for every row, with lang and source.

    ``docs`` must have columns ``lang`` and ``source``.
    """
    return _measured(docs, "doc_id", F.col(id_col).cast("long"), text_col)


def _measured(docs: DataFrame, name: str, own: Column, text_col: str) -> DataFrame:
    """As :func:`measured`, with the column ``own`` by this name in place of the id."""
    rows = docs.select(
        own.alias(name),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        statistics(F.col(text_col)).alias("s"),
    ).select(
        name,
        "lang",
        "source",
        F.col("s.w.n").alias("n_words"),
        F.col("s.word_chars").alias("word_chars"),
        F.col("s.n_symbols").alias("n_symbols"),
        F.col("s.l.n").alias("n_lines"),
        (F.col("s.l.n") - F.col("s.l.distinct")).alias("n_dup_lines"),
        F.col("s.w.repeated").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_cdf(x: float, p: int) -> float:
    """Distribution function of chi-squared by the series of the lower gamma."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def _ranked(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The lowest bin of each key at which the share of its count is reached."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    running = counts.select(*keys, "bin", F.sum("n").over(order).alias("upto"), F.sum("n").over(whole).alias("all"))
    return running.where(F.col("upto") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _binned_median(rows: DataFrame, values: list[Column]) -> DataFrame:
    """``(g, m0, m1, ...)``: the median of each value by group, to within a bin."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(v * _BINS_PER_UNIT).alias("bin")) for i, v in enumerate(values)]))
    counts = rows.select("g", cells.alias("c")).groupBy("g", "c.i", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    found = _ranked(counts, ["g", "i"], 0.5)
    middle = (F.col("bin") + 0.5) / _BINS_PER_UNIT
    return found.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, middle)).alias(f"m{i}") for i in range(len(values))])


def _distance() -> Column:
    """Squared Mahalanobis distance from ``m`` by the inverse factor ``w``."""
    rows = [" + ".join(f"w{i}{k} * (x{k} - m{k})" for k in range(i + 1)) for i in range(_P)]
    return F.expr(" + ".join(f"({row}) * ({row})" for row in rows))


def _inverse_factor(estimates: DataFrame) -> DataFrame:
    """Columns ``w``, the inverse of the Cholesky factor of the covariance ``c``, and the log of its determinant."""
    for k in range(_P):
        rest = lambda i: " - ".join([f"c{i}{k}", *[f"l{i}{j} * l{k}{j}" for j in range(k)]])  # noqa: B023, E731
        estimates = estimates.selectExpr("*", f"sqrt(greatest({rest(k)}, 1e-12D)) AS l{k}{k}")
        estimates = estimates.selectExpr("*", f"1 / l{k}{k} AS w{k}{k}", *[f"({rest(i)}) / l{k}{k} AS l{i}{k}" for i in range(k + 1, _P)])
    for gap in range(1, _P):
        below = [(i, i - gap) for i in range(gap, _P)]
        estimates = estimates.selectExpr("*", *[f"-({' + '.join(f'l{i}{j} * w{j}{k}' for j in range(k, i))}) / l{i}{i} AS w{i}{k}" for i, k in below])
    size = " + ".join(f"ln(l{i}{i})" for i in range(_P))
    return estimates.selectExpr("g", "start", *_M, *_W, f"2 * ({size}) AS logdet")


def _starts(rows: DataFrame) -> DataFrame:
    """``(g, start, m, w, logdet)``: the four starts of each group.

    Only the order of distances matters here, so the scale of a covariance does not.
    """
    medians = stash(_binned_median(rows, [F.col(x) for x in _X]), "medians")
    off = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(_P)]
    spread = _binned_median(rows.join(medians, "g").select("g", *_X, *_M), off)
    spread = spread.select("g", *[F.greatest(1.4826 * F.col(f"m{i}"), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(_P)])
    scales = stash(medians.join(spread, "g"), "scales")
    z = [f"(x{i} - m{i}) / s{i}" for i in range(_P)]
    scored = rows.join(scales, "g").selectExpr("g", *_X, *[f"{v} AS z{i}" for i, v in enumerate(z)])
    scored = scored.selectExpr("*", *[f"tanh(z{i}) AS t{i}" for i in range(_P)], "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(_P)) + ") AS norm")
    scored = scored.selectExpr("*", *[f"if(norm > 0, z{i} / norm, 0D) AS u{i}" for i in range(_P)])
    moments = scored.groupBy("g").agg(
        *[F.expr(f"avg(x{i}) AS a{i}") for i in range(_P)],
        *[F.expr(f"covar_pop({v}{i}, {v}{k}) AS {v}{i}{k}") for v in "xt" for i, k in _PAIRS],
        *[F.expr(f"avg(u{i} * u{k}) AS u{i}{k}") for i, k in _PAIRS],
    )

    def covariance(kind: str, i: int, k: int) -> str:
        if kind == "median":
            return f"s{i} * s{k}" if i == k else "0D"
        if kind == "moments":
            return f"x{i}{k}" + (f" + {FLOORS[i] ** 2!r}D" if i == k else "")
        if kind == "squashed":
            return f"s{i} * s{k}" if i == k else f"s{i} * s{k} * t{i}{k} / sqrt(greatest(t{i}{i}, 1e-6D) * greatest(t{k}{k}, 1e-6D))"
        return f"s{i} * s{k} * (u{i}{k}" + (" + 0.01D)" if i == k else ")")

    def struct(n: int, kind: str) -> str:
        centre = [f"{'a' if kind == 'moments' else 'm'}{i} AS m{i}" for i in range(_P)]
        return f"struct({n} AS start, {', '.join(centre + [f'{covariance(kind, i, k)} AS c{i}{k}' for i, k in _PAIRS])})"

    each = ", ".join(struct(n, kind) for n, kind in enumerate(["median", "moments", "squashed", "signs"]))
    return _inverse_factor(scales.join(moments, "g").selectExpr("g", f"inline(array({each}))"))


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: mean and covariance of the rows nearest by the last estimate."""
    factor = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, _P), _P + 2)
    near = rows.join(estimate, "g").select("g", "start", *_X, F.floor(_BINS_PER_UNIT * F.log1p(_distance())).alias("bin"))
    cut = _ranked(near.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["g", "start"], SUPPORT)
    chosen = near.join(stash(cut.withColumnRenamed("bin", "cut"), "cuts"), ["g", "start"]).where("bin <= cut")
    sums = chosen.groupBy("g", "start").agg(
        *[F.expr(f"avg(x{i}) AS m{i}") for i in range(_P)], *[F.expr(f"covar_pop(x{i}, x{k}) AS v{i}{k}") for i, k in _PAIRS]
    )
    floor = {(i, i): FLOORS[i] ** 2 for i in range(_P)}
    covariance = [f"{factor!r}D * v{i}{k} + {floor.get((i, k), 0.0)!r}D AS c{i}{k}" for i, k in _PAIRS]
    return _inverse_factor(sums.selectExpr("g", "start", *_M, *covariance))


def estimates(rows: DataFrame, trial_steps: int = TRIAL_STEPS, steps: int = STEPS) -> DataFrame:
    """Robust centre, inverse factor and log determinant of each group of ``rows(g, x0, ...)``.

    The covariance of a step carries the floors on its diagonal, so determinants
    are never zero.  The smallest that a group has met is its estimate.
    """
    found = stash(_starts(rows), "starts")
    for _ in range(trial_steps):
        found = stash(_concentrated(rows, found), "estimates")
    whole = F.struct("logdet", "start", *_M, *_W)
    best = stash(found.groupBy("g").agg(F.min(whole).alias("e")).select("g", "e.*"), "best")
    for _ in range(steps - trial_steps):
        last = best.selectExpr("g", "start AS last_start", "logdet AS last", *[f"{c} AS last_{c}" for c in [*_M, *_W]])
        step = _concentrated(rows, best).join(last, "g")
        lower = "logdet < last - 1e-9"
        kept = [f"if({lower}, {c}, last_{c}) AS {c}" for c in [*_M, *_W]]
        best = stash(step.selectExpr("g", "start", *kept, "least(logdet, last) AS logdet", f"{lower} AS moved"), "best")
        if not best.where("moved").limit(1).count():
            break
        best = best.drop("moved")
    return best.select("g", "start", *_M, *_W, "logdet")


def _sources(rows: DataFrame) -> DataFrame:
    """``(lang, source, m, w)``: the estimate that judges the rows of a source; none for those that nothing judges."""
    sizes = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))

    def key(lang: Column, source: Column) -> Column:
        return F.struct(lang.alias("lang"), source.alias("source"))

    none = F.lit(None).cast("string")
    named = sizes.withColumn("k", F.when(F.col("n") >= MIN_ROWS, key(F.col("lang"), F.col("source"))).otherwise(key(F.col("lang"), none)))
    totals = named.groupBy("k").agg(F.sum("n").alias("total"))
    pooled = named.join(totals, "k").withColumn("k", F.when(F.col("total") >= MIN_ROWS, F.col("k")).otherwise(key(none, none))).drop("total")
    enough = pooled.groupBy("k").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_ROWS)
    groups = stash(pooled.join(enough, "k").select("lang", "source", F.xxhash64("k.lang", "k.source").alias("g")), "groups")
    sound = rows.where(~F.col("base_failed")).join(groups, ["lang", "source"])
    vectors = stash(sound.select("g", *[v.alias(x) for x, v in zip(_X, _vector())]), "vectors")
    return stash(groups.join(estimates(vectors), "g").select("lang", "source", *_M, *_W), "sources")


def _judged(rows: DataFrame, sources: DataFrame, alpha: float) -> DataFrame:
    """``rows`` with ``kept`` and ``distance``."""
    small = sources.count() <= BROADCAST_SOURCES
    vectors = rows.select("*", *[v.alias(x) for x, v in zip(_X, _vector())])
    found = vectors.join(F.broadcast(sources) if small else sources, ["lang", "source"], "left")
    outlier = F.coalesce(_distance() > chi2_quantile(1 - alpha, _P), F.lit(False))
    # Not a conjunction: a filter would have its half on base_failed pushed below the statistics and measure twice.
    kept = F.greatest(F.col("base_failed").cast("int"), outlier.cast("int")) == 0
    return found.select(*rows.columns, kept.alias("kept"), F.when(~F.col("base_failed"), _distance()).alias("distance"))


def judged(docs: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, statistics..., base_failed, kept, distance)`` for every row.

    A null text has no words and fails the base rule.  Null languages and
    sources count as empty strings, null ids pass through, repeated rows give
    repeated rows and count as often in the estimates.  An empty table gives an
    empty one.
    """
    rows = stash(measured(docs, id_col, text_col), "statistics")
    return _judged(rows, _sources(rows), alpha).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def drop_rejected(docs: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, all their columns.

    A verdict depends on a row's text, language and source alone and is found where
    the row lies: rows of one id are judged one by one, and rows without an id like
    any other.  Otherwise as :func:`judged`.
    """
    sources = _sources(stash(measured(docs, id_col, text_col), "statistics"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(_measured(docs, "row", row, text_col), sources, alpha).where("kept").select("row.*")
