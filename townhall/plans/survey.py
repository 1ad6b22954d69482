"""Survey flags, screens and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import any_of, flag, row_mean, safe_div
from ..functions.tails import chi2_tail, chi2_tail_of

NO_ANSWER = ("Prefer not to say",)


def answered(c: Column, drop: tuple[str, ...] = NO_ANSWER) -> Column:
    return c.isNotNull() & ~F.coalesce(c.isin(*drop), F.lit(False))


def behaviour_flags(df: DataFrame, sliders: list[str]) -> DataFrame:
    """Mean change, any cut, use of vote taxes, fees, reserves, revenue, and a shifted tax mix."""
    prop, sales = F.col("rev_property"), F.col("rev_sales")
    out = df.withColumn("mean_gf_change", row_mean(sliders)).withColumn("any_cut", any_of([F.col(c) < 0 for c in sliders]))
    out = out.withColumns({"used_vote": any_of([prop > 0, sales > 0]), "used_fees": flag(F.col("rev_fees") > 0), "used_reserves": flag(F.col("reserves") > 0)})
    out = out.withColumn("used_any_lever", F.col("used_vote") | F.col("used_fees"))
    return out.withColumn("shifted_revenue", flag((prop > 0) & (sales < 0)) | flag((sales > 0) & (prop < 0)))


def topline(df: DataFrame, flags: list[str]) -> DataFrame:
    """flag, share, largest first."""
    one = lambda c: F.struct(F.lit(c).alias("flag"), F.avg(F.col(c).cast("int")).alias("share"))
    return df.agg(F.array(*[one(c) for c in flags]).alias("_a")).select(F.inline("_a")).orderBy(F.desc("share"), "flag")


def _screened(counts: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, group, behaviour, n, row_share, expected of counted cells, over the groups that are large enough."""
    rows, cols, all_ = Window.partitionBy(*by, "group"), Window.partitionBy(*by, "behaviour"), Window.partitionBy(*by)
    large = counts.withColumn("rows", F.sum("n").over(rows)).filter((F.col("rows") >= least) & F.col("behaviour").isNotNull())
    sums = large.withColumns({"r": F.sum("n").over(rows), "c": F.sum("n").over(cols), "t": F.sum("n").over(all_)})
    return sums.select(*by, "group", "behaviour", "n", (F.col("n") / F.col("r")).alias("row_share"), (F.col("r") * F.col("c") / F.col("t")).alias("expected"))


def screened_counts(df: DataFrame, group: str, behaviour: str, least: int = 10, drop: tuple[str, ...] = NO_ANSWER) -> DataFrame:
    """group, behaviour, n, row_share, expected over the groups that are large enough."""
    kept = df.filter(answered(F.col(group), drop)).select(F.col(group).alias("group"), F.col(behaviour).cast("string").alias("behaviour"))
    return _screened(kept.groupBy("group", "behaviour").agg(F.count("*").alias("n")), [], least)


def chi2_statistic(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, groups, dof, chi2 of ``screened_counts``; with one degree of freedom, Yates' correction applies.

    Combinations that do not occur have count 0 and their expectation still counts: over all cells,
    sum((n - e)^2 / e) = sum over occurring cells + the expectations of the others.
    """
    one = counts.groupBy(*by).agg(
        F.count_distinct("group").alias("groups"), F.count_distinct("behaviour").alias("behaviours"), F.sum("n").alias("t"), F.sum("expected").alias("seen"),
        F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("plain"), F.count("*").alias("cells"),
        F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("expected")) - 0.5, F.lit(0.0)), F.lit(2)) / F.col("expected")).alias("yates"),
    )
    dof = (F.col("groups") - 1) * (F.col("behaviours") - 1)
    # With 2 x 2 cells the deviations are equal; where a cell is empty, all four are at its expectation.
    full = F.col("cells") == F.col("groups") * F.col("behaviours")
    missing = F.col("t") - F.col("seen")
    shrunk = F.pow(F.greatest(missing - 0.5, F.lit(0.0)), F.lit(2)) / F.when(missing > 0, missing).otherwise(F.lit(1.0))
    value = F.when(dof == 1, F.col("yates") + F.when(full, F.lit(0.0)).otherwise(shrunk)).otherwise(F.col("plain") + F.when(full, F.lit(0.0)).otherwise(missing))
    return one.select(*by, "groups", dof.alias("dof"), F.when(dof == 0, F.lit(0.0)).otherwise(value).alias("chi2"))


def chi2_screen(df: DataFrame, group: str, behaviour: str, least: int = 10) -> dict[str, float] | None:
    """chi2, dof and p; None with fewer than two groups to compare."""
    row = chi2_statistic(screened_counts(df, group, behaviour, least)).first()
    if row.groups < 2:
        return None
    return {"chi2": row.chi2, "dof": row.dof, "p": chi2_tail(row.chi2, row.dof)}


def chi2_grid(df: DataFrame, groups: list[str], behaviours: list[str], least: int = 10, drop: tuple[str, ...] = NO_ANSWER) -> DataFrame:
    """item, outcome, groups, dof, chi2, p for every pair of a grouping and a behaviour column; pairs
    with fewer than two groups to compare are left out.

    One scan: a row yields one cell for each pair, added up before the shuffle, so that what the windows
    get is a few cells for each pair whatever the number of rows.
    """
    cell = lambda g, b: F.struct(F.lit(g).alias("item"), F.lit(b).alias("outcome"), F.col(g).cast("string").alias("group"), F.col(b).cast("string").alias("behaviour"))
    cells = df.select(F.inline(F.array(*[cell(g, b) for g in groups for b in behaviours])))
    counts = cells.filter(answered(F.col("group"), drop)).groupBy("item", "outcome", "group", "behaviour").agg(F.count("*").alias("n"))
    out = chi2_statistic(_screened(counts, ["item", "outcome"], least), ("item", "outcome")).filter(F.col("groups") > 1)
    return out.withColumn("p", chi2_tail_of(F.col("chi2"), F.col("dof")))


def pool_distribution(df: DataFrame, column: str, targets: DataFrame, drop: tuple[str, ...] = NO_ANSWER) -> DataFrame:
    """category, pool and each benchmark of ``targets`` with its gap; categories nobody chose are 0."""
    counts = df.filter(answered(F.col(column), drop)).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).select("category", "share")
    out = targets.join(shared, "category", "left").withColumn("pool", F.coalesce("share", F.lit(0.0))).drop("share")
    names = [c for c in targets.columns if c != "category"]
    return out.withColumns({f"gap_vs_{c}": F.col("pool") - F.col(c) for c in names})


def post_stratified(df: DataFrame, column: str, target: dict[str, float], drop: tuple[str, ...] = NO_ANSWER, out: str = "weight") -> DataFrame:
    """target share / pool share for each row; other answers weigh 1, non-answers nothing (NULL)."""
    counts = df.filter(answered(F.col(column), drop)).groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("_n"))
    shares = counts.withColumn("_s", F.col("_n") / F.sum("_n").over(Window.partitionBy())).select("_c", "_s")
    goals = df.sparkSession.createDataFrame(sorted(target.items()), "_c string, _t double")
    factors = shares.join(F.broadcast(goals), "_c").select("_c", (F.col("_t") / F.col("_s")).alias("_f"))
    both = df.join(F.broadcast(factors), F.col(column) == F.col("_c"), "left")  # one row for each target
    return both.withColumn(out, F.when(answered(F.col(column), drop), F.coalesce("_f", F.lit(1.0)))).drop("_c", "_f")


def raked(df: DataFrame, targets: dict[str, dict[str, float]], most: int = 50, tolerance: float = 1e-6, trim: tuple[float, float] = (0.2, 5.0), out: str = "weight") -> DataFrame:
    """Weights of mean 1 fitted to several margins in turn, then trimmed and scaled once more.

    Rows with the same answers have the same weight, so the fit runs over the table of distinct
    answer combinations, whose size is the product of the items' categories (other answers and
    non-answers fold into one each): the only thing that comes to the driver. The weights join back.
    The lower trim is the trim[0] / 10 quantile of row weights (interpolated) or 0.2.
    """
    keys = list(targets)
    folded = df
    for i, c in enumerate(keys):
        known = F.col(c).isin(*targets[c])
        folded = folded.withColumn(f"_k{i}", F.when(~answered(F.col(c)), F.lit("")).when(known, F.col(c)).otherwise(F.lit("\x00")))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = [tuple(r) for r in folded.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    if not rows:
        return df.withColumn(out, F.lit(None).cast("double"))
    cells, n = [r[:-1] for r in rows], [r[-1] for r in rows]
    total = sum(n)
    w = [1.0] * len(cells)
    for _ in range(most):
        before = list(w)
        for i, c in enumerate(keys):
            mass: dict[str, float] = {}
            for cell, x, k in zip(cells, w, n):
                if cell[i] != "":
                    mass[cell[i]] = mass.get(cell[i], 0.0) + x * k
            whole = sum(mass.values())
            factor = {a: t / (mass[a] / whole) for a, t in targets[c].items() if mass.get(a, 0) > 0}
            w = [x * factor.get(cell[i], 1.0) if cell[i] != "" else x for cell, x in zip(cells, w)]
        scale = total / sum(x * k for x, k in zip(w, n))
        w = [x * scale for x in w]
        if max(abs(a - b) for a, b in zip(w, before)) < tolerance:
            break
    lo = max(_quantile(w, n, trim[0] / 10), 0.2)
    w = [min(max(x, lo), trim[1]) for x in w]
    scale = total / sum(x * k for x, k in zip(w, n))
    table = df.sparkSession.createDataFrame([(*cell, x * scale) for cell, x in zip(cells, w)], ", ".join(f"{k} string" for k in names) + f", {out} double")
    return folded.join(F.broadcast(table), names).drop(*names)  # one row for each combination of categories


def _quantile(values: list[float], counts: list[int], q: float) -> float:
    """The interpolated quantile of values that each stand for ``counts`` rows."""
    ordered = sorted(zip(values, counts))
    place = q * (sum(counts) - 1)
    below, above = int(place), min(int(place) + 1, sum(counts) - 1)

    def at(k: int) -> float:
        for v, c in ordered:
            if k < c:
                return v
            k -= c
        return ordered[-1][0]

    return at(below) + (place - below) * (at(above) - at(below))


def weighted_comparison(df: DataFrame, flags: list[str], weight: str) -> DataFrame:
    """flag, unweighted, weighted, shift_pp."""
    w = F.col(weight)

    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        both = v.isNotNull() & w.isNotNull()
        return F.struct(F.lit(c).alias("flag"), F.avg(v).alias("unweighted"), safe_div(F.sum(F.when(both, v * w)), F.sum(F.when(both, w))).alias("weighted"))

    rows = df.agg(F.array(*[one(c) for c in flags]).alias("_a")).select(F.inline("_a"))
    return rows.withColumn("shift_pp", (F.col("weighted") - F.col("unweighted")) * 100)


def _drawn(u: Column, options: dict[str, float]) -> Column:
    """The option at ``u`` (0 to 1) of the shares laid end to end."""
    total, run, picked = sum(options.values()), 0.0, F
    for name, share in options.items():
        run += share
        picked = picked.when(u * total < run, name)
    return picked.otherwise(list(options)[-1])


def synthetic_pool(spark, n: int, choices: dict[str, dict[str, float]], seed: int = 2026, given: dict[str, tuple[str, dict[str, dict[str, float]]]] | None = None) -> DataFrame:
    """n rows of weighted choices for each item, the same on any partitioning.

    ``given`` names for an item an earlier one and the shares that hold under its answers; under all
    other answers the shares of ``choices`` do.
    """
    df = spark.range(n).withColumnRenamed("id", "respondent")
    for k, (item, options) in enumerate(choices.items()):
        u = F.pmod(F.xxhash64("respondent", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        on, shares = (given or {}).get(item, ("", {}))
        picked = F
        for answer, own in shares.items():
            picked = picked.when(F.col(on) == answer, _drawn(u, own))
        df = df.withColumn(item, picked.otherwise(_drawn(u, options)) if shares else _drawn(u, options))
    return df
