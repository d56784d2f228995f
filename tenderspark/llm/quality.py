"""Operator 10: quality rules, with DataFrame functions only.

Plain rules first: fewer than 10 words, or over 20 % of the words in repeated 5-word windows, fail. The rest is judged
by minimum-covariance-determinant estimates over five transformed statistics, one for each (language, source) group:

1. Medians and median deviations, from counts on a fine grid, give three starts: the deviations alone, the correlations
   of the statistics' tanh scores, and those of their spatial signs.
2. Concentration steps: of a group's rows, the (n + p + 1) / 2 nearest by Mahalanobis distance give the next centre and
   covariance. After two steps the start of least determinant is kept for each group and goes on until no group's
   determinant falls any more (at most `steps`).
3. Reweighting: the rows within the 97.5 % quantile of the chi-squared distribution give the centre and covariance.
4. Rows whose squared distance then exceeds the cutoff are rejected.

A step is one aggregation: rows are counted and summed by group and fine bin of distance (1 % wide), and the nearest bins
that hold enough rows are added up. So no group's rows meet anywhere, only sums do. Estimates, a few rows a group, are
broadcast up to BROADCAST_GROUPS groups and otherwise joined under salts, so a group with a third of all rows is dealt
to many tasks.

Every group, however small, is judged by its own centre. A floor is added to each statistic's variance. The last
covariance is shrunk towards that within the groups of its language, and this towards that within all groups, as if
PRIOR_ROWS rows of the wider one had been seen, which is defined for every size: a group of few rows has the wider
spread around its own centre, a large one its own. The wider ones are means over groups, by rows and less the wider a
group is beside the floors: groups too small to leave out their outliers then weigh little. A single row is its own
centre and stays.

Defined cases: a null text has no words and fails, so does an empty one; a null doc_id stays null; null languages and
sources are groups of their own; repeated rows count each; a group without a row that passes the plain rules has no
estimate, and its distances are null; statistics that are constant in a group get the floor as their spread, so equal
rows are never outliers; very long texts are used whole; an empty table gives an empty result; `keep_good` gives back the
input's columns, whatever their names. Windows are compared by 64-bit hashes of their words' hashes: two different
windows of a text of 20,000 words meet with a probability of about 1e-11.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics and the least standard deviation that each is given.
VECTOR = {"length": 0.5, "word_length": 0.4, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.1}
#: Means over words count so many words of usual length more, so that short texts do not scatter.
PRIOR_WORDS, PRIOR_LENGTH = 20, 5
#: Rows that the wider covariance counts for beside a group's own.
PRIOR_ROWS = 20
#: Squared distance beyond which a row is an outlier.
CUTOFF = 32.0
#: Medians and 97.5 % quantiles of the chi-squared distribution by degrees of freedom, fixed values.
CHI2_MEDIAN = {1: 0.455, 2: 1.386, 3: 2.366, 4: 3.357, 5: 4.351}
CHI2_975 = {1: 5.024, 2: 7.378, 3: 9.348, 4: 11.143, 5: 12.833}
#: Groups up to which estimates are broadcast, about 1 kB each, and the salts beyond.
BROADCAST_GROUPS, SALTS = 20_000, 16
#: Cells of a statistic's grid for medians, per unit; bins of the logarithm of distances, per doubling.
_CELLS, _BINS = 2048, 64


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def base_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the five statistics of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = df.withColumns({"_q_words": words, "_q_lines": lines})
    step = step.withColumn("_q_hashes", F.transform("_q_words", lambda w: F.xxhash64(w)))
    n, h = F.size("_q_words"), F.col("_q_hashes")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    step = step.withColumn("_q_windows", windows)

    def covered(at: Column) -> Column:
        """Words in windows that begin at these rising places."""
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def again(s: Column) -> Column:
        """The windows, sorted with their places, that equal a neighbour."""
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)))

    w = F.col("_q_windows")
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_let(_let(placed, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"]))), covered))
    found = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": repeats,
    }
    # generated, so that a filter on them is not pushed down into the steps above and computes them over and over
    once = step.withColumn("_q_found", F.explode(F.array(F.struct(*[c.alias(name) for name, c in found.items()]))))
    return once.select(*df.columns, *[F.col(f"_q_found.{name}").alias(f"{prefix}{name}") for name in found])


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 10) | (F.col(f"{prefix}n_repeat_words") * 100 > n * 20)


def vector(prefix: str = "") -> dict[str, Column]:
    n = F.col(f"{prefix}n_words").cast("double")
    more = n + PRIOR_WORDS
    return {
        "length": F.log1p(n),
        "word_length": (F.col(f"{prefix}word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / more,
        "symbols": F.log1p(F.col(f"{prefix}n_symbols") / more),
        "dup_lines": F.log1p(F.col(f"{prefix}n_dup_lines").cast("double")) / F.log1p(n + 9),
        "repeats": F.sqrt(F.col(f"{prefix}n_repeat_words") / more),
    }


class Estimator:
    """Estimates over rows with a group (_q_group) and the named statistics (_q_x_*); floors: their least deviations."""

    def __init__(self, floors: dict[str, float], broadcast_groups: int = BROADCAST_GROUPS, salts: int = SALTS):
        self.names, self.floors, self.p = list(floors), list(floors.values()), len(floors)
        self.pairs = [(i, j) for i in range(self.p) for j in range(i + 1)]
        self.broadcast_groups, self.salts, self.groups = broadcast_groups, salts, 0

    @property
    def columns(self) -> list[str]:
        return [f"_q_m_{i}" for i in range(self.p)] + [f"_q_l_{i}_{j}" for i, j in self.pairs]

    def _joined(self, rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
        if self.groups <= self.broadcast_groups:
            return rows.join(F.broadcast(estimates), "_q_group", how)
        salted = estimates.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        return rows.withColumn("_q_salt", (F.monotonically_increasing_id() % self.salts).cast("int")).join(salted, ["_q_group", "_q_salt"], how).drop("_q_salt")

    def with_distance(self, rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
        """Add the squared distance _q_d from the estimate of each row's group, and _q_u_*, the statistics less its
        centre: forward substitution through the Cholesky factor, a column a statistic."""
        joined, p = self._joined(rows, estimates, how), range(self.p)
        steps = [f"_q_x_{n} - _q_m_{i} AS _q_u_{i}" for i, n in enumerate(self.names)]
        steps += [f"(_q_u_{i}{''.join(f' - _q_l_{i}_{j} * _q_y_{j}' for j in range(i))}) / _q_l_{i}_{i} AS _q_y_{i}" for i in p]
        return joined.selectExpr("*", *steps, f"{' + '.join(f'_q_y_{i} * _q_y_{i}' for i in p)} AS _q_d").drop(*[f"_q_y_{i}" for i in p])

    def _factored(self, df: DataFrame) -> DataFrame:
        """The Cholesky factor of the covariance _q_c_* with the floors added, and the logarithm of its determinant."""
        steps = []
        for i, j in self.pairs:
            rest = f"_q_c_{i}_{j}{''.join(f' - _q_l_{i}_{k} * _q_l_{j}_{k}' for k in range(j))}"
            floor = self.floors[i] ** 2
            steps.append(f"{f'sqrt(greatest({rest} + {floor!r}D, {floor / 4!r}D))' if i == j else f'({rest}) / _q_l_{j}_{j}'} AS _q_l_{i}_{j}")
        det = " + ".join(f"2 * ln(_q_l_{i}_{i})" for i in range(self.p))
        return df.selectExpr("*", *steps, f"{det} AS _q_det").drop(*[f"_q_c_{i}_{j}" for i, j in self.pairs])

    def medians(self, rows: DataFrame) -> DataFrame:
        """(_q_group, _q_n, _q_m_*, _q_s_*): medians and median deviations on the grid."""
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"_q_x_{n}") * _CELLS).alias("cell")) for i, n in enumerate(self.names)]))
        grid = rows.select("_q_group", cells.alias("_q_cell")).groupBy("_q_group", "_q_cell.i", "_q_cell.cell").agg(F.count(F.lit(1)).alias("n"))

        def middle(counts: DataFrame, cell: str) -> DataFrame:
            """Add the least cell at which half of a statistic's rows are reached; a window over cells, not rows."""
            by = Window.partitionBy("_q_group", "i")
            upto = counts.withColumns({"upto": F.sum("n").over(by.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(by)})
            return upto.withColumn(f"mid_{cell}", F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col(cell))).over(by))

        found = middle(grid, "cell").select("_q_group", "i", "n", "mid_cell", F.abs(F.col("cell") - F.col("mid_cell")).alias("off"))
        found = middle(found.groupBy("_q_group", "i", "mid_cell", "off").agg(F.sum("n").alias("n")), "off")
        agg = [F.max(F.when(F.col("i") == 0, F.col("all"))).alias("_q_n")]
        for i in range(self.p):
            agg.append(F.max(F.when(F.col("i") == i, (F.col("mid_cell") + 0.5) / _CELLS)).alias(f"_q_m_{i}"))
            agg.append(F.max(F.when(F.col("i") == i, F.col("mid_off") / _CELLS)).alias(f"_q_s_{i}"))
        return found.groupBy("_q_group").agg(*agg)

    def starts(self, rows: DataFrame, medians: DataFrame) -> DataFrame:
        """Three first estimates for each group, (_q_group, _q_start, _q_n, centre, factor)."""
        spread = [F.sqrt(F.pow(1.4826 * F.col(f"_q_s_{i}"), 2) + self.floors[i] ** 2) for i in range(self.p)]
        scaled = medians.select("_q_group", "_q_n", *[f"_q_m_{i}" for i in range(self.p)], *[x.alias(f"_q_s_{i}") for i, x in enumerate(spread)])
        z = self._joined(rows, scaled).withColumns({f"_q_z_{i}": (F.col(f"_q_x_{n}") - F.col(f"_q_m_{i}")) / F.col(f"_q_s_{i}") for i, n in enumerate(self.names)})
        norm = F.sqrt(sum((F.col(f"_q_z_{i}") * F.col(f"_q_z_{i}") for i in range(self.p)), F.lit(1e-12)))
        z = z.withColumn("_q_norm", norm).withColumns({f"_q_t_{i}": F.tanh(F.col(f"_q_z_{i}")) for i in range(self.p)}).withColumns({f"_q_g_{i}": F.col(f"_q_z_{i}") / F.col("_q_norm") for i in range(self.p)})
        kinds = ("t", "g")
        sums = [F.avg(F.col(f"_q_{k}_{i}") * F.col(f"_q_{k}_{j}")).alias(f"_q_{k}_{i}_{j}") for k in kinds for i, j in self.pairs]
        same = [F.first(c).alias(c) for c in ("_q_n", *[f"_q_m_{i}" for i in range(self.p)], *[f"_q_s_{i}" for i in range(self.p)])]
        found = z.groupBy("_q_group").agg(*same, *sums)

        def covariances(number: int, kind: str | None) -> Column:
            """Deviations with correlations of one kind; a little is added so that constants have none."""
            of = {}
            for i, j in self.pairs:
                both = F.col(f"_q_s_{i}") * F.col(f"_q_s_{j}")
                own = F.lit(float(i == j)) if kind is None or i == j else F.col(f"_q_{kind}_{i}_{j}") / F.sqrt((F.col(f"_q_{kind}_{i}_{i}") + 1e-3) * (F.col(f"_q_{kind}_{j}_{j}") + 1e-3))
                of[i, j] = both * own - (self.floors[i] ** 2 if i == j else 0.0)  # the floor comes back in the factor
            return F.struct(F.lit(number).alias("start"), *[c.alias(f"c_{i}_{j}") for (i, j), c in of.items()])

        tried = found.withColumn("_q_e", F.explode(F.array(covariances(0, None), covariances(1, "t"), covariances(2, "g"))))
        flat = tried.select("_q_group", F.col("_q_e.start").alias("_q_start"), "_q_n", *[f"_q_m_{i}" for i in range(self.p)], *[F.col(f"_q_e.c_{i}_{j}").alias(f"_q_c_{i}_{j}") for i, j in self.pairs])
        return self._factored(flat)

    def binned(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """Counts and sums of the rows by group, start and bin of distance, with the group's estimate and, in _q_before,
        its number of rows in nearer bins."""
        keys = ["_q_group", "_q_start"]
        near = self.with_distance(rows, estimates).withColumn("_q_bin", F.expr(f"cast(floor(log2(greatest(_q_d, 1e-9D)) * {_BINS}) AS int)"))
        sums = [f"sum(_q_u_{i}) AS _q_su_{i}" for i in range(self.p)] + [f"sum(_q_u_{i} * _q_u_{j}) AS _q_sc_{i}_{j}" for i, j in self.pairs]
        same = [f"first({c}) AS {c}" for c in ("_q_n", "_q_det", *[f"_q_m_{i}" for i in range(self.p)])]
        bins = near.groupBy(*keys, "_q_bin").agg(*map(F.expr, ["count(1) AS _q_k", *sums, *same]))
        before = Window.partitionBy(*keys).orderBy("_q_bin").rowsBetween(Window.unboundedPreceding, -1)
        return bins.withColumn("_q_before", F.coalesce(F.sum("_q_k").over(before), F.lit(0)))

    def _moments(self, bins: DataFrame) -> DataFrame:
        """Centre and covariance of the rows in these bins, with their number in _q_k and the former determinant."""
        p, keys = range(self.p), ["_q_group", "_q_start"]
        sums = [f"sum({c}) AS {c}" for c in ["_q_k", *[f"_q_su_{i}" for i in p], *[f"_q_sc_{i}_{j}" for i, j in self.pairs]]]
        same = ["first(_q_n) AS _q_n", "first(_q_det) AS _q_last", *[f"first(_q_m_{i}) AS _q_m_{i}" for i in p]]
        added = bins.groupBy(*keys).agg(*map(F.expr, [*sums, *same]))
        means = [f"_q_m_{i} + _q_su_{i} / _q_k AS _q_m_{i}" for i in p]
        return added.selectExpr(*keys, "_q_n", "_q_k", "_q_last", *means, *[f"_q_sc_{i}_{j} / _q_k - _q_su_{i} / _q_k * (_q_su_{j} / _q_k) AS _q_c_{i}_{j}" for i, j in self.pairs])

    def concentrated(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """One concentration step of every estimate."""
        half = F.floor((F.col("_q_n") + self.p + 1) / 2)
        return self._factored(self._moments(self.binned(rows, estimates).where(F.col("_q_before") < half))).drop("_q_k")

    def _shrunk(self, moments: DataFrame) -> DataFrame:
        """Covariances with those within the language's groups and within all groups mixed in by counts."""
        spread = " + ".join(f"_q_c_{i}_{i} / {floor ** 2!r}D" for i, floor in enumerate(self.floors))
        n = F.expr(f"_q_k / (1 + ({spread}) / {self.p})")
        named = moments.withColumns({"_q_lang": F.to_json(F.struct(F.get_json_object("_q_group", "$.lang"))), "_q_one": F.lit(1)})
        wide = named.groupBy("_q_lang").agg(F.sum(n).alias("_q_nl"), *[F.sum(n * F.col(f"_q_c_{i}_{j}")).alias(f"_q_cl_{i}_{j}") for i, j in self.pairs])
        whole = wide.groupBy(F.lit(1).alias("_q_one")).agg(F.sum("_q_nl").alias("_q_na"), *[F.sum(f"_q_cl_{i}_{j}").alias(f"_q_ca_{i}_{j}") for i, j in self.pairs])  # one row
        out = named.join(wide, "_q_lang").join(F.broadcast(whole), "_q_one")
        mixed = []
        for i, j in self.pairs:
            of_lang = f"(_q_cl_{i}_{j} + {PRIOR_ROWS} * (_q_ca_{i}_{j} / _q_na)) / (_q_nl + {PRIOR_ROWS})"
            mixed.append(f"(_q_k * _q_c_{i}_{j} + {PRIOR_ROWS} * ({of_lang})) / (_q_k + {PRIOR_ROWS}) AS _q_c_{i}_{j}")
        return out.selectExpr(*[c for c in moments.columns if not c.startswith("_q_c_")], *mixed)

    def reweighted(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """The estimates from all rows within the 97.5 % quantile, distances being scaled by their median."""
        bins = self.binned(rows, estimates)
        by = Window.partitionBy("_q_group", "_q_start")
        middle = F.max(F.when(F.col("_q_before") * 2 < F.col("_q_n"), F.col("_q_bin"))).over(by)
        reach = F.log2(F.lit(CHI2_975[self.p] / CHI2_MEDIAN[self.p])) * _BINS
        # the quantile itself where the median is less than usual
        least = F.log2(F.lit(CHI2_975[self.p])) * _BINS
        near = bins.withColumn("_q_reach", F.greatest(middle + reach, least)).where(F.col("_q_bin") <= F.col("_q_reach"))
        return self._factored(self._shrunk(materialise(self._moments(near))))

    def scaled(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """The estimates with the factor widened where the median distance is above that of the normal distribution."""
        middle = F.max(F.when(F.col("_q_before") * 2 < F.col("_q_n"), F.col("_q_bin")))
        wide = self.binned(rows, estimates).groupBy("_q_group").agg(middle.alias("_q_bin"))
        by = F.sqrt(F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("_q_bin") / _BINS) / CHI2_MEDIAN[self.p]))
        out = estimates.join(wide, "_q_group").withColumn("_q_by", by)
        return out.select("_q_group", *[f"_q_m_{i}" for i in range(self.p)], *[(F.col(f"_q_l_{i}_{j}") * F.col("_q_by")).alias(f"_q_l_{i}_{j}") for i, j in self.pairs])

    def fit(self, rows: DataFrame, steps: int = 10) -> DataFrame:
        """(_q_group, centre, factor) by minimum covariance determinants, a row a group."""
        medians = materialise(self.medians(rows))
        self.groups = medians.count()
        now = materialise(self.starts(rows, medians))
        for _ in range(2):
            now = materialise(self.concentrated(rows, now))
        first = F.row_number().over(Window.partitionBy("_q_group").orderBy("_q_det", "_q_start"))  # three rows each
        now = now.withColumn("_q_first", first).where("_q_first = 1").drop("_q_first")
        for _ in range(steps - 2):
            now = materialise(self.concentrated(rows, now))
            if not now.where("_q_det < _q_last - 1e-6").limit(1).count():
                break
        now = materialise(self.reweighted(rows, now))
        return materialise(self.scaled(rows, now))


def group_key() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string"), F.col("source").cast("string")))


def _with_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the base statistics, _q_failed and the vector; df has the columns text and _q_group, and only _q_ ones else."""
    stats = base_statistics(df, prefix="_q_b_")
    return stats.withColumns({"_q_failed": base_failed("_q_b_"), **{f"_q_x_{n}": c for n, c in vector("_q_b_").items() if n in names}})


def _narrow(documents: DataFrame, names: list[str]) -> DataFrame:
    """The documents' ids and statistics; rows of the text column's size are not kept."""
    return _with_statistics(documents.select(F.col("doc_id").alias("_q_id"), F.col("text").cast("string").alias("text"), group_key().alias("_q_group")), names).drop("text")


def _fitted(statistics: DataFrame, estimator: Estimator, steps: int) -> DataFrame:
    """An estimate for each group of the rows that pass the plain rules."""
    return estimator.fit(statistics.where(~F.col("_q_failed")).select("_q_group", *[f"_q_x_{n}" for n in estimator.names]), steps)


def judge(documents: DataFrame, cutoff: float = CUTOFF, steps: int = 10, floors: dict[str, float] = VECTOR, **options) -> DataFrame:
    """The base statistics of each row with base_failed, the squared distance and the verdict `kept`."""
    estimator = Estimator(floors, **options)
    stats = materialise(_narrow(documents, estimator.names))
    judged = estimator.with_distance(stats, _fitted(stats, estimator, steps), "left")
    kept = ~F.col("_q_failed") & F.coalesce(F.col("_q_d") <= cutoff, F.lit(True))
    return judged.select(F.col("_q_id").alias("doc_id"), *[F.col(f"_q_b_{b}").alias(b) for b in BASE], F.col("_q_failed").alias("base_failed"), F.col("_q_d").alias("distance"), kept.alias("kept"))


def keep_good(documents: DataFrame, cutoff: float = CUTOFF, steps: int = 10, floors: dict[str, float] = VECTOR, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns. The texts are read twice; with up to `broadcast_groups`
    groups they are not shuffled."""
    estimator = Estimator(floors, **options)
    estimates = _fitted(materialise(_narrow(documents, estimator.names)), estimator, steps)
    whole = documents.select(F.struct("*").alias("_q_doc"), F.col("text").cast("string").alias("text"), group_key().alias("_q_group"))
    good = _with_statistics(whole, estimator.names).drop("text").where(~F.col("_q_failed"))
    return estimator.with_distance(good, estimates, "left").where(F.coalesce(F.col("_q_d") <= cutoff, F.lit(True))).select("_q_doc.*")
