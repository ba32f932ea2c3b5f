"""Quality rules: fixed base rules, then robust multivariate outliers by minimum covariance determinant (MCD).

Text statistics are one JVM pass over whole texts without a shuffle. What the MCD works on is a narrow table of five transformed
ratios per document. It is fitted for each language and source: from three deterministic starts around medians and MADs, concentration steps take the share
``H`` of documents nearest to the current centre and re-estimate centre and covariance; the start with the least determinant goes
on; then one reweighting step. A step is one pass: counts and sums per group and bin of log distance, partial aggregates, so that a hot
source is added up where it lies; the cut and the new estimate come from these few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import remove, stored
from .text import BLANKS, whole, words

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Production parameters of the MCD: share of documents in a concentration step, documents for a group of its own,
#: probability that a clean Gaussian document stays, concentration steps from each start, further ones from the best (as many at every size of input).
H, MIN_GROUP, KEEP, FIRST_STEPS, STEPS = 0.7, 100, 0.9999, 2, 8
#: Groups whose parameters are sent to every task (about 300 bytes each); with more they are joined by shuffle, where a group is split
#: into parts of so many rows, and the table of groups by SALTS.
MAX_SENT_GROUPS, PART_ROWS, SALTS = 20_000, 1_000_000, 32
#: Features and the standard deviation that is added to each in any case: it keeps constant features from rejecting on a trifle.
FEATURES = {"log_word_length": 0.10, "symbols": 0.06, "dup_lines": 0.20, "repeats": 0.15, "shouting": 0.08}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")
_P = len(FEATURES)
_NAMES = [f"x{i}" for i in range(_P)]


# --- statistics of a text ---------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array ``w`` (an attribute, not an expression)."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    none = F.array().cast("array<array<int>>")

    def covered(s: Column) -> Column:
        m = F.size(s) - 1
        pairs = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        at = F.flatten(F.coalesce(F.filter(pairs, lambda p: p.isNotNull()), none))
        return _let(at, lambda p: F.size(F.array_distinct(F.flatten(F.array(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))))

    def count(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(sorted_, covered))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows, count)).cast("bigint")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouts``, all bigint, over the whole text.

    Null text counts as empty. ``n_lines`` counts lines with a word, ``n_shouts`` the capitals A to Z and exclamation marks.
    """
    keep = docs.columns
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.withColumn("_t", whole(F.col("text"))).select(*keep, "_t", words(F.col("_t")).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    return rows.select(
        *keep, n.cast("bigint").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.regexp_count(t, F.lit("[A-Z!]")).cast("bigint").alias("n_shouts"),
    )


def features() -> list[Column]:
    """Log of the mean word length, and arcsine square roots of four shares, each with a few clean units added so that short texts vary less."""

    def share(part: Column, of: Column, clean: int) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), part / (of + clean))))

    c = F.col
    return [
        F.log((c("word_chars") + 1.0) / (c("n_words") + 1.0)), share(c("n_symbols"), c("word_chars"), 50), share(c("n_dup_lines"), c("n_lines"), 5),
        share(c("n_repeat_words"), c("n_words"), 50), share(c("n_shouts"), c("word_chars"), 50),
    ]


# --- chi-square without SciPy -----------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(q: float, p: int) -> float:
    """What the covariance of a Gaussian's inner share ``q`` is multiplied by to be that of the whole."""
    return q / chi2_cdf(chi2_quantile(q, p), p + 2)


# --- MCD --------------------------------------------------------------------------------------------------------

_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_PARAMS = [f"m{i}" for i in range(_P)] + [f"l{i}{j}" for i, j in _PAIRS]


# Small linear algebra per group is written as SQL text whose later columns read earlier ones: one analysis a step, whatever its length.


def _cholesky(keys: list[str], means: list[str], cov: list[str]) -> list[str]:
    """``keys, m0.., l00..`` from SQL for the centre and for the covariance (the added variances included), of a row."""
    out = [*keys, *[f"{m} AS m{i}" for i, m in enumerate(means)]]
    for (i, j), c in zip(_PAIRS, cov, strict=True):
        rest = c + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({rest}, 1e-12D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from a row's joined ``m`` and ``l``, by forward substitution."""
    z: list[str] = []
    for i in range(_P):
        z.append(f"((x{i} - m{i}{''.join(f' - l{i}{j} * {v}' for j, v in enumerate(z))}) / l{i}{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in z))


_SUM_NAMES = ["n", *[f"t{i}" for i in range(_P)], *[f"s{i}{j}" for i, j in _PAIRS]]
_FLOOR = [v * v for v in FEATURES.values()]


def _sums() -> list[Column]:
    told = ["count(*) AS n", *[f"sum(x{i}) AS t{i}" for i in range(_P)], *[f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in _PAIRS]]
    return [F.expr(x) for x in told]


def _estimate(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre and Cholesky factor from counts and sums, the covariance times ``scale`` plus the added variances."""
    cov = [f"((s{i}{j} / n - t{i} / n * t{j} / n) * {scale}D{f' + {_FLOOR[i]}D' if i == j else ''})" for i, j in _PAIRS]
    return sums.selectExpr(*_cholesky(keys, [f"t{i} / n" for i in range(_P)], cov))


def _quantile_bins(rows: DataFrame, keys: list[str], value: str, share: float, alias: str) -> DataFrame:
    """The smallest integer ``value`` that at least ``share`` of the rows of ``keys`` don't exceed. One row per key and value meets."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    whole_ = W.partitionBy(*keys)
    run = counts.select(*keys, value, F.sum("_c").over(whole_.orderBy(value)).alias("_run"), F.sum("_c").over(whole_).alias("_all"))
    return run.where(F.col("_run") >= F.ceil(F.col("_all") * share)).groupBy(*keys).agg(F.min(value).alias(alias))


class Groups:
    """How rows meet the parameters of their groups: by sending these to every task where they are few, else by a join in which large groups are split.

    ``rows(_h, g, parts, ..)``: ``parts`` is the number of parts of the row's group, ``_h`` a fixed hash of the row's own, so that copies are dealt out too.
    """

    def __init__(self, few: bool):
        self.few = few

    def met(self, rows: DataFrame, params: DataFrame) -> DataFrame:
        if self.few:
            return rows.join(F.broadcast(params.drop("parts")), "g")
        split = params.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        return rows.withColumn("_salt", F.pmod("_h", "parts")).join(split, ["g", "_salt"]).drop("_salt")


_GRID = 256.0


def _starts(rows: DataFrame, groups: Groups, sizes: DataFrame) -> DataFrame:
    """``g, parts, start, m.., l..``: three starts of each group, all centred on the medians (on a grid of 1/256): variances from MADs; the covariance
    of squashed standard scores; that of the directions from the centre, which no distance weighs."""
    each = range(_P)
    spread = lambda told, name: told.groupBy("g").agg(*[F.expr(f"max(CASE WHEN f = {i} THEN {name} END) AS {name}{i}") for i in each])
    long = rows.select("g", F.posexplode(F.expr(f"array({', '.join(f'floor(x{i} * {_GRID}D)' for i in each)})")).alias("f", "b"))
    med, med_path = stored(spread(_quantile_bins(long, ["g", "f"], "b", 0.5, "med"), "med").join(sizes, "g"), "median")
    off = groups.met(rows, med).select("g", F.posexplode(F.expr(f"array({', '.join(f'floor(abs(x{i} * {_GRID}D - med{i} - 0.5D))' for i in each)})")).alias("f", "b"))
    mad = spread(_quantile_bins(off, ["g", "f"], "b", 0.5, "mad"), "mad")
    scales = [f"sqrt(pow(mad{i} / {_GRID}D * 1.4826D, 2D) + {_FLOOR[i]}D) AS d{i}" for i in each]
    told, told_path = stored(med.join(mad, "g").selectExpr("g", "parts", *[f"(med{i} + 0.5D) / {_GRID}D AS m{i}" for i in each], *scales), "scales")
    scored = groups.met(rows, told).selectExpr("g", *[f"(x{i} - m{i}) / d{i} AS z{i}" for i in each])
    squared = " + ".join(f"z{i} * z{i}" for i in each)
    shapes = [f"avg(tanh(z{i}) * tanh(z{j})) AS a{i}{j}" for i, j in _PAIRS] + [f"avg(z{i} * z{j} / r) AS b{i}{j}" for i, j in _PAIRS]
    both = told.join(scored.selectExpr("*", f"greatest({squared}, 1e-12D) AS r").groupBy("g").agg(*[F.expr(x) for x in shapes]), "g")

    def c(k: int, i: int, j: int) -> str:
        # off the diagonal the shape's correlation, on it the MAD's variance
        if i == j:
            return f"d{i} * d{i}"
        a = "_ab"[k]
        return f"0.99D * {a}{i}{j} / sqrt(greatest({a}{i}{i} * {a}{j}{j}, 1e-12D)) * d{i} * d{j}" if k else "0D"

    cov = ", ".join(f"struct({', '.join([f'{k} AS start', *[f'{c(k, i, j)} AS c{i}{j}' for i, j in _PAIRS]])})" for k in range(3))
    made = both.select("g", "parts", *[f"m{i}" for i in each], F.expr(f"inline(array({cov}))"))
    made = made.selectExpr(*_cholesky(["g", "parts", "start"], [f"m{i}" for i in each], [f"c{i}{j}" for i, j in _PAIRS]))
    made, _ = stored(made, "starts")
    remove(rows.sparkSession, med_path)
    remove(rows.sparkSession, told_path)
    return made


def _step(rows: DataFrame, params: DataFrame, groups: Groups, h: float) -> DataFrame:
    """A concentration step of every group and start: one pass over the rows."""
    keys = ["g", "start"]
    binned = groups.met(rows, params).groupBy(*keys, F.floor(F.log(_distance() + 1e-9) * 32).alias("b")).agg(*_sums())
    by = W.partitionBy(*keys)
    before = F.sum("n").over(by.orderBy("b")) - F.col("n")
    # bins up to the first at which the share is reached
    near = binned.withColumn("_before", before).withColumn("_all", F.sum("n").over(by)).where(F.col("_before") < F.ceil(F.col("_all") * h))
    sums = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUM_NAMES])
    return _estimate(sums, keys, consistency(h, _P)).join(params.select(*keys, "parts"), keys)


def _few(groups: DataFrame) -> bool:
    """Whether a table with one row per group is small enough to be sent to every task."""
    return groups.limit(MAX_SENT_GROUPS + 1).count() <= MAX_SENT_GROUPS


def fit_mcd(rows: DataFrame, sizes: DataFrame, h: float = H, few: bool | None = None) -> DataFrame:
    """``g, parts, m.., l..``: reweighted MCD centre and Cholesky factor for each group of ``rows(_h, g, parts, x0..)``; ``sizes(g, parts)`` lists the groups.

    ``few`` tells whether the groups are few enough for their parameters to be sent to every task; without it they are counted.
    """
    spark = rows.sparkSession
    groups = Groups(_few(sizes) if few is None else few)
    params = _starts(rows, groups, sizes)
    for k in range(FIRST_STEPS + STEPS):
        if k == FIRST_STEPS:
            # the least determinant, then the first start
            size = F.expr("round(2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(_P)) + "), 9)")
            params = params.groupBy("g").agg(F.min_by(F.struct("parts", "start", *_PARAMS), F.struct(size.alias("size"), "start")).alias("p")).select("g", "p.*")
        params, path = stored(_step(rows, params, groups, h), "mcd")
        if k:
            remove(spark, last)
        last = path
    inner = groups.met(rows, params).where(_distance() <= chi2_quantile(0.975, _P)).groupBy("g").agg(*_sums())
    return stored(_estimate(inner, ["g"], consistency(0.975, _P)).join(sizes, "g"), "mcd")[0]


def judge(docs: DataFrame, carry: list[str], keep: float = KEEP, min_group: int = MIN_GROUP, few: bool | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs(text, lang, source, ..)`` with the statistics, ``base_failed``, ``distance`` and ``kept``.

    A document that passes the base rules is rejected if its squared Mahalanobis distance exceeds the chi-square quantile
    ``keep`` under the fit for its language and source; groups with fewer than ``min_group`` passing documents take the fit of their language,
    small languages that of all documents, and where even those are fewer every passing document is kept. Null language or source is a
    group of its own; null text counts as empty; repeated rows are judged each; an empty table gives no rows. A carried column
    may not be named like a result.
    """
    if clash := sorted(set(carry) & {*STATISTICS, "base_failed", "distance", "kept"}):
        raise ValueError(f"columns named like results: {clash}")
    needed = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), "text", "lang", "source")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    x = [v.alias(f"x{i}") for i, v in enumerate(features())]
    name = lambda *fields: F.to_json(F.struct(*fields))
    lang = F.col("lang").alias("l")
    table = text_statistics(needed).select("_carry", *STATISTICS, failed.alias("base_failed"), *x, F.xxhash64(F.monotonically_increasing_id()).alias("_h"), name(lang, F.col("source").alias("s")).alias("own"), name(lang, F.lit("lang").alias("k")).alias("wider"))
    table, _ = stored(table, "quality")  # which fixes the rows' hashes
    plan = _plan(table.where("not base_failed"), min_group)
    few = _few(plan) if few is None else few
    if few:
        met = table.join(F.broadcast(plan), "own", "left")
    else:
        salt = F.pmod("_h", F.lit(SALTS))
        met = table.withColumn("_salt", salt).join(plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["own", "_salt"], "left").drop("_salt")
    rows = met.where("not base_failed").select("_h", *_NAMES, F.inline("fits"))
    sizes, _ = stored(plan.select(F.inline("fits")).distinct(), "groups")
    params = fit_mcd(rows, sizes, few=few)
    judged = met.withColumn("g", F.when(~F.col("base_failed"), F.col("judge.g"))).withColumn("parts", F.col("judge.parts"))
    # a row without a judge meets no group, and its random part keeps such rows apart
    params = params.withColumnRenamed("g", "_g")
    if few:
        out = judged.join(F.broadcast(params.drop("parts")), F.col("g") == F.col("_g"), "left")
    else:
        split = params.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        own = judged.withColumn("_salt", F.pmod("_h", F.coalesce("parts", F.lit(1 << 20).cast("bigint"))))
        out = own.join(split, (F.coalesce("g", F.lit("")) == F.col("_g")) & (F.col("_salt") == F.col("_s")), "left")
    kept = ~F.col("base_failed") & F.coalesce(_distance() <= chi2_quantile(keep, _P), F.lit(True))
    return out.select("_carry", *STATISTICS, "base_failed", _distance().alias("distance"), kept.alias("kept")).select("_carry.*", *STATISTICS, "base_failed", "distance", "kept")


def _plan(passed: DataFrame, min_group: int) -> DataFrame:
    """``own, fits, judge``: for each language and source the group that judges it, and the groups for which its documents are fitted.

    A language, or all documents, is fitted only where some group needs it. One row per language and source.
    """
    counts, _ = stored(passed.groupBy("own", "wider").agg(F.count("*").alias("n")), "counts")
    by_lang = counts.groupBy("wider").agg(F.sum("n").alias("n1"), F.min("n").alias("least"))
    every = by_lang.agg(F.sum("n1").alias("n2"), F.min("n1").alias("least1"))
    told = counts.join(by_lang, "wider").crossJoin(F.broadcast(every))
    entry = lambda g, n: F.struct(g.alias("g"), F.ceil(n / PART_ROWS).cast("bigint").alias("parts"))
    own, wide, whole_ = entry(F.col("own"), F.col("n")), entry(F.col("wider"), F.col("n1")), entry(F.lit("all"), F.col("n2"))
    enough = [F.col(c) >= min_group for c in ("n", "n1", "n2")]
    judge_ = F.when(enough[0], own).when(enough[1], wide).when(enough[2], whole_)
    fits = F.array_compact(F.array(F.when(enough[0], own), F.when(enough[1] & (F.col("least") < min_group), wide), F.when(enough[2] & (F.col("least1") < min_group), whole_)))
    return stored(told.select("own", fits.alias("fits"), judge_.alias("judge")), "plan")[0]
