"""The library's operators over the benchmark tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import semantics
from .operators import aggregates, bins, reshape, selection, series
from .plans import budget, documents, people, survey, votes, wages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    """n_name, ts (month as yyyymm), votes: revenue of each nation's customers."""
    joined = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ts")
    return joined.groupBy("n_name", month).agg(F.sum("o_totalprice").alias("votes"))


def _ballots(spark: SparkSession, d: str) -> DataFrame:
    counts = t(spark, d, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ts")).agg(F.count("*").alias("n"))
    return counts.select("ts", F.sum("n").over(Window.partitionBy().orderBy("ts")).alias("ballots"))


MONTHLY = """
WITH m AS (SELECT n_name, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS ts, sum(o_totalprice) AS votes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT ts, sum(n) OVER (ORDER BY ts)::BIGINT AS ballots FROM (
  SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS ts, count(*) AS n FROM orders GROUP BY 1)),
s AS (SELECT n_name, m.ts, votes, votes / sum(votes) OVER (PARTITION BY m.ts) AS share, ballots FROM m JOIN b ON m.ts = b.ts)
"""


@query(MONTHLY + "SELECT n_name, ts, round(votes, 2) AS votes, round(share, 8) AS share, ballots FROM s")
def share_within_period(spark, d):
    shared = votes.shares(_monthly(spark, d), "n_name", _ballots(spark, d))
    return shared.select("n_name", "ts", r("votes", 2).alias("votes"), r("share", 8).alias("share"), "ballots")


@query(MONTHLY + """SELECT f.n_name, round(intercept + slope * 34500, 8) AS forecast, round(final, 8) AS final, round(final - (intercept + slope * 34500), 8) AS error
FROM (SELECT n_name, regr_slope(share, ballots) AS slope, regr_intercept(share, ballots) AS intercept, arg_max(share, ts) AS final FROM s GROUP BY 1) f""")
def vote_share_forecast(spark, d):
    out = votes.final_forecast(votes.shares(_monthly(spark, d), "n_name", _ballots(spark, d)), "n_name")
    return out.select("n_name", *[r(c, 8).alias(c) for c in ("forecast", "final", "error")])


@query(MONTHLY + """SELECT e.n_name, e.ts, e.points::BIGINT AS points, round(g.i + g.s * e.ballots - (e.i + e.s * 34500), 7) AS error FROM (
  SELECT n_name, ts, ballots, count(*) OVER w AS points, regr_slope(share, ballots) OVER w AS s, regr_intercept(share, ballots) OVER w AS i
  FROM s WINDOW w AS (PARTITION BY n_name ORDER BY ts ROWS UNBOUNDED PRECEDING)) e
JOIN (SELECT n_name, regr_slope(share, ballots) AS s, regr_intercept(share, ballots) AS i FROM s GROUP BY 1) g ON e.n_name = g.n_name
WHERE points BETWEEN 2 AND 6""")
def cumulative_forecast_error(spark, d):
    out = votes.reference_cumulative_error(votes.shares(_monthly(spark, d), "n_name", _ballots(spark, d)), "n_name")
    return out.select("n_name", "ts", "points", r("error", 7).alias("error"))


@query("""SELECT c_mktsegment, count(*)::BIGINT AS n, round(regr_slope(o_totalprice, c_acctbal), 6) AS slope,
  round(regr_intercept(o_totalprice, c_acctbal), 3) AS intercept, round(corr(c_acctbal, o_totalprice), 7) AS r
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def group_linreg(spark, d):
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fits = aggregates.linreg(both, ["c_mktsegment"], "c_acctbal", "o_totalprice")
    return fits.select("c_mktsegment", "n", r("slope", 6).alias("slope"), r("intercept", 3).alias("intercept"), r("r", 7).alias("r"))


YEARLY = """WITH y AS (SELECT o_orderpriority AS area, year(o_orderdate)::INT AS year, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
"""


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("area"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))


@query(YEARLY + "SELECT area, year, round(value, 2) AS value, round(value / max(value) FILTER (WHERE year = 1995) OVER (PARTITION BY area) * 100, 6) AS indexed FROM y")
def index_to_base_year(spark, d):
    out = wages.employment_index(_yearly(spark, d), 1995)
    return out.select("area", "year", r("value", 2).alias("value"), r("indexed").alias("indexed"))


@query(YEARLY + "SELECT area, year, round(value / lag(value) OVER (PARTITION BY area ORDER BY year) - 1, 8) AS pct_change FROM y")
def pct_change_series(spark, d):
    return series.pct_change(_yearly(spark, d), ["area"], "year", "value").select("area", "year", r("pct_change", 8).alias("pct_change"))


@query(YEARLY + """SELECT area, round(a, 2) AS "start", round(b, 2) AS "end", round(b - a, 2) AS change, round(b / a - 1, 8) AS growth
FROM (SELECT area, max(value) FILTER (WHERE year = 1993) AS a, max(value) FILTER (WHERE year = 1997) AS b FROM y GROUP BY 1)""")
def endpoint_growth(spark, d):
    out = series.endpoints(_yearly(spark, d), ["area"], "year", "value", 1993, 1997)
    return out.select("area", r("start", 2).alias("start"), r("end", 2).alias("end"), r("change", 2).alias("change"), r("growth", 8).alias("growth"))


@query(YEARLY + "SELECT area, min(year) AS first_at, round(arg_min(value, year), 2) AS first_value, max(year) AS last_at, round(arg_max(value, year), 2) AS last_value, round(arg_max(value, year) - arg_min(value, year), 2) AS gain FROM y WHERE value IS NOT NULL GROUP BY 1")
def valid_ends(spark, d):
    y = _yearly(spark, d)
    out = series.valid_ends(y, ["area"], "year", "value").join(series.latest_minus_first(y, ["area"], "year", "value"), "area")
    return out.select("area", "first_at", r("first_value", 2).alias("first_value"), "last_at", r("last_value", 2).alias("last_value"), r("gain", 2).alias("gain"))


@query(YEARLY + ", g AS (SELECT area, year, value / lag(value) OVER (PARTITION BY area ORDER BY year) AS ratio FROM y) SELECT area, min(year) FILTER (WHERE ratio < 1) AS crossover FROM g GROUP BY 1")
def crossover_year(spark, d):
    g = series.pct_change(_yearly(spark, d), ["area"], "year", "value")
    return series.crossover(g, ["area"], "year", F.col("pct_change") + 1 < 1)


@query("""WITH v AS (SELECT n_name, year(o_orderdate)::INT AS year, sum(o_totalprice) AS revenue FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, year, round(revenue, 2) AS revenue, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, n_name)::INT AS rank FROM v""")
def rank_first_ties(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    by = joined.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))
    return selection.rank_first(by, ["year"], "revenue", ["n_name"]).select("n_name", "year", r("revenue", 2).alias("revenue"), "rank")


@query("""SELECT c_mktsegment, """ + ", ".join(f'count(*) FILTER (WHERE p_age >= {a} AND p_age < {b})::BIGINT AS "{a}-{b - 1}"' for a, b in zip(bins.POPULATION_AGES, bins.POPULATION_AGES[1:])) + """
FROM (SELECT c_mktsegment, abs(c_custkey * 7919 % 120) AS p_age FROM customer) WHERE p_age < 101 GROUP BY 1""")
def age_bins_pivot(spark, d):
    aged = t(spark, d, "customer").withColumn("p_age", F.abs(F.col("c_custkey") * 7919 % 120))
    return people.age_mix(aged, ["c_mktsegment"], F.col("p_age"), F.lit(1).cast("long"))


@query("""WITH g(ord, generation, lo, hi) AS (VALUES """ + ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(bins.GENERATIONS)) + """)
SELECT c_mktsegment, ord, generation, count(*)::BIGINT AS n FROM customer JOIN g ON 1895 + c_custkey % 160 BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def generation_range_join(spark, d):
    born = (1895 + F.col("c_custkey") % 160).cast("int")
    return people.generation_mix(t(spark, d, "customer"), ["c_mktsegment"], born, F.lit(1).cast("long")).withColumn("n", F.col("n").cast("long"))


@query("""SELECT o_orderkey, c_mktsegment FROM (SELECT * FROM customer WHERE c_acctbal > 0) c RIGHT JOIN orders ON c_custkey = o_custkey""")
def right_join_history(spark, d):
    some = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return some.join(t(spark, d, "orders"), "o_custkey", "right").select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def left_join_dimension(spark, d):
    dim = t(spark, d, "nation").filter("n_regionkey < 3")
    return t(spark, d, "customer").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("""SELECT coalesce(a.nation, b.nation) AS nation, round(a.value::DOUBLE / b.value, 8) AS ratio
FROM (SELECT c_nationkey AS nation, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS nation, count(*) AS value FROM supplier GROUP BY 1) b ON a.nation = b.nation""")
def jobs_housing_ratio(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 300000").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = big.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("value"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("value"))
    return people.ratio_series(a, b, "nation").select("nation", r("ratio", 8).alias("ratio"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.value - b.value AS difference FROM (SELECT p_size AS k, count(*) AS value FROM part WHERE p_size < 40 GROUP BY 1) a
FULL JOIN (SELECT p_size AS k, count(*) AS value FROM part WHERE p_size > 10 AND p_retailprice > 1000 GROUP BY 1) b ON a.k = b.k""")
def full_align_difference(spark, d):
    count = lambda f: t(spark, d, "part").filter(f).groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("value"))
    return series.difference(count("p_size < 40"), count("p_size > 10 AND p_retailprice > 1000"), "k")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_membership(spark, d):
    some = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_membership(spark, d):
    has = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(has, "c_custkey", "left_anti").select("c_custkey")


GRADES = """WITH e AS (SELECT year(o_orderdate)::INT AS year, (o_custkey % 5)::INT AS step, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2),
w AS (SELECT year - step AS start_year, step, n - CASE WHEN lag(step) OVER c = step - 1 THEN lag(n) OVER c END AS change FROM e WINDOW c AS (PARTITION BY year - step ORDER BY step))
SELECT start_year, 'g' || (step - 1) || '-g' || step AS transition, change FROM w WHERE step > 0 AND change IS NOT NULL"""


@query(GRADES)
def cohort_progression(spark, d):
    grades = [f"g{i}" for i in range(5)]
    counts = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.concat(F.lit("g"), F.col("o_custkey") % 5).alias("g"))
    wide = reshape.long_to_wide(counts, ["year"], "g", grades, F.count(F.lit(1)))
    return people.cohort_progression(wide, grades).select("start_year", "transition", "change")


TURNOUT = """WITH v AS (SELECT c_custkey AS voter_id, (1900 + c_custkey % 80)::INT AS birth_year, (1992 + c_custkey % 4)::INT AS registered FROM customer),
h AS (SELECT o_custkey AS voter_id, year(o_orderdate)::INT AS year, count(*) AS voted FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' GROUP BY 1, 2),
years(year) AS (VALUES (1993), (1994), (1995), (1996), (1997)),
edges(age_bin, lo, hi) AS (VALUES """ + ", ".join(f"('{a}-{b - 1}', {a}, {b})" for a, b in zip(bins.VOTER_AGES, bins.VOTER_AGES[1:])) + """),
g AS (SELECT v.*, years.year FROM v JOIN (SELECT DISTINCT voter_id FROM h) USING (voter_id) CROSS JOIN years WHERE years.year >= registered),
c AS (SELECT g.year, age_bin, sum(coalesce(voted, 0)) AS votes, count(DISTINCT g.voter_id) AS voters FROM g
  LEFT JOIN h ON g.voter_id = h.voter_id AND g.year = h.year JOIN edges ON g.year - birth_year >= lo AND g.year - birth_year < hi GROUP BY 1, 2),
f AS (SELECT years.year, e.age_bin, c.votes / nullif(c.voters, 0) AS rate FROM years CROSS JOIN edges e LEFT JOIN c ON c.year = years.year AND c.age_bin = e.age_bin)
SELECT age_bin, CASE WHEN year % 2 = 0 THEN 'Even' ELSE 'Odd' END AS cycle, round(avg(rate), 8) AS turnout FROM f GROUP BY 1, 2"""


@query(TURNOUT)
def turnout_by_age_cycle(spark, d):
    voters = t(spark, d, "customer").select(F.col("c_custkey").alias("voter_id"), (1900 + F.col("c_custkey") % 80).cast("int").alias("birth_year"), (1992 + F.col("c_custkey") % 4).cast("int").alias("registered"))
    history = t(spark, d, "orders").select(F.col("o_custkey").alias("voter_id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderpriority") == "5-LOW", "Primary").otherwise("General").alias("kind"))
    return people.turnout(voters, history, [1993, 1994, 1995, 1996, 1997]).withColumn("turnout", r("turnout", 8))


@query("""WITH s AS (SELECT event_type AS "group", (value > 50)::VARCHAR AS behaviour FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
c AS (SELECT "group", behaviour, count(*)::BIGINT AS n FROM s GROUP BY 1, 2)
SELECT "group", behaviour, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY "group"), 8) AS row_share,
  round((sum(n) OVER (PARTITION BY "group"))::DOUBLE * sum(n) OVER (PARTITION BY behaviour) / sum(n) OVER (), 6) AS expected FROM c""")
def crosstab_screened(spark, d):
    e = t(spark, d, "events").withColumn("high", F.col("value") > 50)
    out = survey.screened_counts(e, "event_type", "high")
    return out.select("group", "behaviour", "n", r("row_share", 8).alias("row_share"), r("expected", 6).alias("expected"))


@query("""WITH c AS (SELECT o_orderpriority AS g, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
x AS (SELECT n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c)
SELECT (SELECT count(DISTINCT g) FROM c)::BIGINT AS groups, ((SELECT count(DISTINCT g) FROM c) - 1) * ((SELECT count(DISTINCT b) FROM c) - 1) AS dof, round(sum((n - e) ** 2 / e), 6) AS chi2 FROM x""")
def chi2_screen(spark, d):
    out = survey.chi2_statistic(survey.screened_counts(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))
    return out.select("groups", "dof", r("chi2", 6).alias("chi2"))


@query("""WITH o AS (SELECT o_orderpriority AS priority, 'Q' || quarter(o_orderdate) AS "quarter", o_orderstatus AS status,
  CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS price FROM orders),
s AS (SELECT 'priority' AS item, 'status' AS outcome, priority AS g, status AS b FROM o UNION ALL SELECT 'priority', 'price', priority, price FROM o
  UNION ALL SELECT 'quarter', 'status', "quarter", status FROM o UNION ALL SELECT 'quarter', 'price', "quarter", price FROM o),
c AS (SELECT item, outcome, g, b, count(*)::DOUBLE AS n FROM s WHERE g IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
m AS (SELECT item, outcome, g, sum(n) AS r FROM c GROUP BY ALL HAVING sum(n) >= 10),
k AS (SELECT item, outcome, b, sum(n) AS k FROM c SEMI JOIN m USING (item, outcome, g) GROUP BY ALL),
x AS (SELECT item, outcome, g, b, coalesce(n, 0) AS n, r * k / sum(r * k) OVER w * sum(coalesce(n, 0)) OVER w AS e
  FROM m JOIN k USING (item, outcome) LEFT JOIN c USING (item, outcome, g, b) WINDOW w AS (PARTITION BY item, outcome)),
f AS (SELECT item, outcome, count(DISTINCT g)::BIGINT AS groups, (count(DISTINCT g) - 1) * (count(DISTINCT b) - 1) AS dof, sum((n - e) ** 2 / e) AS chi2 FROM x GROUP BY ALL)
SELECT item, outcome, groups, dof, round(chi2, 6) AS chi2,
  round(exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2), lambda i: (chi2 / 2) ** i / gamma(i + 1))), 6) AS p FROM f WHERE groups > 1""")
def chi2_grid(spark, d):
    price = F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 200000, "middle").otherwise("high")
    o = t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), F.col("o_orderstatus").alias("status"), price.alias("price")
    )
    out = survey.chi2_grid(o, ["priority", "quarter"], ["status", "price"])
    return out.withColumns({"chi2": r("chi2"), "p": r("p")})


@query("""SELECT o_orderpriority, o_orderstatus, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY o_orderpriority), 8) AS row_share
FROM (SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2)""")
def crosstab_shares(spark, d):
    return aggregates.crosstab(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus").withColumn("row_share", r("row_share", 8))


@query("""SELECT item, n, answered, round(answered::DOUBLE / n, 8) AS answered_share, round(hit::DOUBLE / n, 8) AS literal_share FROM (
  SELECT 'quality' AS item, count(*)::BIGINT AS n, count(quality)::BIGINT AS answered, count(*) FILTER (WHERE quality = 1) AS hit FROM labels
  UNION ALL SELECT 'toxic', count(*), count(toxic), count(*) FILTER (WHERE toxic = 1) FROM labels)""")
def item_audit(spark, d):
    out = aggregates.item_audit(t(spark, d, "labels"), ["quality", "toxic"], "1")
    return out.select("item", "n", "answered", r("answered_share", 8).alias("answered_share"), r("literal_share", 8).alias("literal_share"))


@query("""SELECT c_mktsegment, n, round(share, 8) AS share FROM (SELECT c_mktsegment, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM customer GROUP BY 1) WHERE n >= 20""")
def value_counts(spark, d):
    return aggregates.value_counts(t(spark, d, "customer"), "c_mktsegment", 20).withColumn("share", r("share", 8))


#: How the survey and budget queries read a submission out of an order line.
_SUBMISSION = {
    **{f"gf_{dep}": (7 + 3 * i, 51) for i, dep in enumerate(budget.DEPARTMENTS)},
    "rev_fees": (11, 51), "rev_property": (13, 51), "rev_sales": (17, 51), "reserves": (5, 9),
}


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    value = lambda m, n, c: ((F.col("o_orderkey") * m + F.col("o_custkey")) % n - (0 if c == "reserves" else 25)).cast("double").alias(c)
    return t(spark, d, "orders").select("o_orderkey", *[value(m, n, c) for c, (m, n) in _SUBMISSION.items()])


SUBMISSIONS = "WITH q AS (SELECT o_orderkey, " + ", ".join(f"((o_orderkey * {m} + o_custkey) % {n} - {0 if c == 'reserves' else 25})::DOUBLE AS {c}" for c, (m, n) in _SUBMISSION.items()) + " FROM orders)\n"
_SPEND = " + ".join(f"gf_{k} / 100 * {a}" for k, a in budget.DEPARTMENTS.items())
_REVENUE = " + ".join(f"rev_{k} / 100 * {a}" for k, a in budget.REVENUE.items())
_CUTS = ", ".join(f"{{'a': -gf_{k} / 100 * {a}, 'i': {-i}, 'n': '{k}'}}" for i, (k, a) in enumerate(budget.DEPARTMENTS.items()))
SCORED = SUBMISSIONS + f""", b AS (SELECT *, {_SPEND} AS spend_change, {_REVENUE} AS revenue_only, list_max([{_CUTS}]) AS cut FROM q),
s AS (SELECT o_orderkey, spend_change, revenue_only, revenue_only + reserves AS revenue_total, greatest(0, -spend_change) AS net_cuts,
  7.5 + spend_change - (revenue_only + reserves) AS remaining_2026, 6.5 + spend_change - revenue_only AS remaining_2027,
  revenue_only > 0.01 AS used_revenue, rev_sales > 0 OR rev_property > 0 AS used_vote, reserves > 0 AS used_reserves, CASE WHEN cut.a > 0.01 THEN cut.n END AS top_cut FROM b)
"""


@query(SCORED + """SELECT o_orderkey, round(spend_change, 4) AS spend_change, round(net_cuts, 4) AS net_cuts, round(revenue_total, 4) AS revenue_total,
  round(remaining_2026, 4) AS remaining_2026, round(remaining_2027, 4) AS remaining_2027, remaining_2026 <= 0.05 AND remaining_2027 <= 0.05 AS balanced, used_vote, top_cut,
  round(CASE WHEN revenue_total + net_cuts > 0 THEN revenue_total / (revenue_total + net_cuts) ELSE 0 END, 4) AS rev_share FROM s""")
def budget_score(spark, d):
    out = budget.scored(_submissions(spark, d))
    return out.select("o_orderkey", *[r(c, 4).alias(c) for c in ("spend_change", "net_cuts", "revenue_total", "remaining_2026", "remaining_2027")], "balanced", "used_vote", "top_cut", r("rev_share", 4).alias("rev_share"))


@query(SCORED + """, t AS (SELECT *, floor(revenue_total * 100 + 0.5) / 100 AS rt, floor(spend_change * 100 + 0.5) / 100 AS sc FROM s)
SELECT k.top_cut, k.c, a.* FROM (SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE used_revenue)::BIGINT AS "usedRevenue", count(*) FILTER (WHERE used_vote)::BIGINT AS "usedVote",
  count(*) FILTER (WHERE used_reserves)::BIGINT AS "usedReserves",
  round(sum(CASE WHEN rt + greatest(0, -sc) > 0 THEN rt / (rt + greatest(0, -sc)) ELSE 0 END), 3) AS "revShareSum" FROM t) a,
(SELECT top_cut, count(*)::BIGINT AS c FROM t WHERE top_cut IS NOT NULL GROUP BY 1) k""")
def public_tally(spark, d):
    tally = budget.public_tally(budget.stored(budget.scored(_submissions(spark, d))))
    return tally.select(F.explode("cutTally").alias("top_cut", "c"), "n", "usedRevenue", "usedVote", "usedReserves", r("revShareSum", 3).alias("revShareSum"))


@query(SUBMISSIONS + """SELECT count(*) FILTER (WHERE reserves <= 6 AND (gf_police BETWEEN -20 AND 20))::BIGINT AS accepted, count(*)::BIGINT AS n FROM q""")
def validated_split(spark, d):
    rows = _submissions(spark, d).withColumn("reserves", F.when(F.col("reserves") > 6, -1.0).otherwise(F.col("reserves"))).withColumn("gf_police", F.col("gf_police") * 1.25)
    good, _ = budget.validated(rows, ["o_orderkey"])
    return good.agg(F.count("*").alias("accepted")).crossJoin(rows.agg(F.count("*").alias("n")))


@query(SUBMISSIONS + """, f AS (SELECT """ + " OR ".join(f"gf_{k} < 0" for k in budget.DEPARTMENTS) + """ AS any_cut, rev_property > 0 OR rev_sales > 0 AS used_vote, rev_fees > 0 AS used_fees,
  reserves > 0 AS used_reserves, (rev_property > 0 AND rev_sales < 0) OR (rev_sales > 0 AND rev_property < 0) AS shifted_revenue FROM q)
SELECT flag, round(share, 8) AS share FROM (UNPIVOT (SELECT avg(any_cut::INT) AS any_cut, avg(used_vote::INT) AS used_vote, avg(used_fees::INT) AS used_fees, avg(used_reserves::INT) AS used_reserves,
  avg((used_vote OR used_fees)::INT) AS used_any_lever, avg(shifted_revenue::INT) AS shifted_revenue FROM f) ON COLUMNS(*) INTO NAME flag VALUE share)""")
def topline_flags(spark, d):
    flags = survey.behaviour_flags(_submissions(spark, d), [f"gf_{k}" for k in budget.DEPARTMENTS])
    return survey.topline(flags, ["any_cut", "used_vote", "used_fees", "used_reserves", "used_any_lever", "shifted_revenue"]).withColumn("share", r("share", 8))


@query(SUBMISSIONS + """SELECT o_orderkey, round((""" + " + ".join(f"gf_{k}" for k in budget.DEPARTMENTS) + f""") / {len(budget.DEPARTMENTS)}, 8) AS mean_gf_change FROM q""")
def row_reduce(spark, d):
    return _submissions(spark, d).select("o_orderkey", r(semantics.row_mean([f"gf_{k}" for k in budget.DEPARTMENTS]), 8).alias("mean_gf_change"))


_TARGET = {"AUTOMOBILE": 0.3, "BUILDING": 0.2, "FURNITURE": 0.2, "MACHINERY": 0.2}
POST = "WITH g(c, t) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _TARGET.items()) + """),
s AS (SELECT c_mktsegment AS c, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1),
w AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment IS NOT NULL THEN coalesce(t / share, 1.0) END AS weight FROM customer LEFT JOIN s ON c_mktsegment = s.c LEFT JOIN g ON s.c = g.c)
"""


@query(POST + "SELECT c_custkey, round(weight, 8) AS weight FROM w")
def post_stratify(spark, d):
    return survey.post_stratified(t(spark, d, "customer"), "c_mktsegment", _TARGET).select("c_custkey", r("weight", 8).alias("weight"))


@query(POST + "SELECT round(sum(c_acctbal * weight) / sum(weight), 6) AS weighted_mean, round(sum(weight) ** 2 / sum(weight * weight), 4) AS effective_n, round(count(weight) / (sum(weight) ** 2 / sum(weight * weight)), 8) AS design_effect FROM w")
def weighted_mean_kish(spark, d):
    w = survey.post_stratified(t(spark, d, "customer"), "c_mktsegment", _TARGET)
    return w.agg(
        r(aggregates.weighted_mean(F.col("c_acctbal"), F.col("weight")), 6).alias("weighted_mean"), r(aggregates.effective_n(F.col("weight")), 4).alias("effective_n"),
        r(aggregates.design_effect(F.col("weight")), 8).alias("design_effect"),
    )


@query(POST + """SELECT 'in_debt' AS flag, round(avg((c_acctbal < 0)::INT), 8) AS unweighted, round(sum((c_acctbal < 0)::INT * weight) / sum(weight), 8) AS weighted,
  round((sum((c_acctbal < 0)::INT * weight) / sum(weight) - avg((c_acctbal < 0)::INT)) * 100, 6) AS shift_pp FROM w""")
def weighted_shift(spark, d):
    w = survey.post_stratified(t(spark, d, "customer"), "c_mktsegment", _TARGET).withColumn("in_debt", F.col("c_acctbal") < 0)
    out = survey.weighted_comparison(w.withColumn("in_debt", F.col("in_debt").cast("int")), ["in_debt"], "weight")
    return out.select("flag", r("unweighted", 8).alias("unweighted"), r("weighted", 8).alias("weighted"), r("shift_pp").alias("shift_pp"))


@query("WITH g(category, bench) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in {**_TARGET, "NOBODY": 0.1}.items()) + """),
s AS (SELECT c_mktsegment AS c, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT category, bench::DOUBLE AS bench, round(coalesce(share, 0), 8) AS pool, round(coalesce(share, 0) - bench::DOUBLE, 8) AS gap_vs_bench FROM g LEFT JOIN s ON category = c""")
def representativeness_gap(spark, d):
    targets = spark.createDataFrame(sorted({**_TARGET, "NOBODY": 0.1}.items()), "category string, bench double")
    out = survey.pool_distribution(t(spark, d, "customer"), "c_mktsegment", targets)
    return out.select("category", "bench", r("pool", 8).alias("pool"), r("gap_vs_bench", 8).alias("gap_vs_bench"))


RAKED = "WITH RECURSIVE g(a, ta) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in {**_TARGET, "HOUSEHOLD": 0.1}.items()) + """),
h(b, tb) AS (VALUES ('0', 0.5), ('1', 0.3), ('2', 0.2)),
p AS (SELECT c_custkey, c_mktsegment AS a, (c_nationkey % 3)::VARCHAR AS b FROM customer),
cells AS (SELECT a, b, ta::DOUBLE AS ta, tb::DOUBLE AS tb, count(*)::DOUBLE AS n FROM p LEFT JOIN g USING (a) LEFT JOIN h USING (b) GROUP BY ALL),
fit AS (SELECT 0 AS i, a, b, ta, tb, n, 1.0::DOUBLE AS w, 1.0::DOUBLE AS moved FROM cells
  UNION ALL SELECT i + 1, a, b, ta, tb, n, w3, max(abs(w3 - w)) OVER () FROM (
    SELECT *, w2 * sum(n) OVER () / sum(w2 * n) OVER () AS w3 FROM (
      SELECT *, CASE WHEN tb IS NULL THEN w1 ELSE w1 * tb / (sum(w1 * n) OVER (PARTITION BY b) / sum(w1 * n) FILTER (WHERE b IS NOT NULL) OVER ()) END AS w2 FROM (
        SELECT *, CASE WHEN ta IS NULL THEN w ELSE w * ta / (sum(w * n) OVER (PARTITION BY a) / sum(w * n) FILTER (WHERE a IS NOT NULL) OVER ()) END AS w1
        FROM fit WHERE i < 50 AND moved >= 1e-6)))),
o AS (SELECT c_custkey, w FROM p JOIN (SELECT * FROM fit WHERE i = (SELECT max(i) FROM fit)) f ON p.a IS NOT DISTINCT FROM f.a AND p.b IS NOT DISTINCT FROM f.b),
k AS (SELECT c_custkey, least(greatest(w, (SELECT greatest(quantile_cont(w, 0.02), 0.2) FROM o)), 5.0) AS w FROM o)
SELECT c_custkey, round(w * count(*) OVER () / sum(w) OVER (), 8) AS weight FROM k"""


@query(RAKED)
def rake_margins(spark, d):
    """Weights of the customers after fitting two margins."""
    c = t(spark, d, "customer").withColumn("region", (F.col("c_nationkey") % 3).cast("string"))
    out = survey.raked(c, {"c_mktsegment": {**_TARGET, "HOUSEHOLD": 0.1}, "region": {"0": 0.5, "1": 0.3, "2": 0.2}})
    return out.select("c_custkey", r("weight", 8).alias("weight"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1""")
def dedup_keep_first(spark, d):
    first = reshape.keep_first(t(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH m AS (SELECT doc_id, source, lang = 'es' AS a, lang = 'fr' AS b, max(lang = 'es') OVER (PARTITION BY source) AS any_a, max(lang = 'fr') OVER (PARTITION BY source) AS any_b FROM documents)
SELECT doc_id FROM m WHERE CASE WHEN any_a THEN a WHEN any_b THEN b ELSE true END""")
def fallback_cascade(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    return selection.fallback_cascade(docs, ["source"], [F.col("lang") == "es", F.col("lang") == "fr"], "all").select("doc_id")


@query("SELECT o_orderpriority, year(o_orderdate)::INT AS year, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1, 2")
def median_resample_year(spark, d):
    return series.median_by_year(t(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice").withColumn("median", r("median", 4))


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 3) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM lineitem GROUP BY 1")
def percentile_bands(spark, d):
    out = t(spark, d, "lineitem").groupBy("l_returnflag").agg(*aggregates.bands("l_extendedprice"))
    return out.select("l_returnflag", *[r(f"p{p}", 3).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


@query("""WITH y AS (SELECT o_orderpriority AS area, year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) <> 1995 GROUP BY 1, 2),
g AS (SELECT area, (1992 + i)::INT AS year FROM (SELECT DISTINCT area FROM y), range(7) t(i)),
f AS (SELECT g.area, g.year, n FROM g LEFT JOIN y ON g.area = y.area AND g.year = y.year)
SELECT area, year, coalesce(n, floor((lag(n) OVER w + lead(n) OVER w) / 2)::BIGINT) AS n FROM f WINDOW w AS (PARTITION BY area ORDER BY year)""")
def gap_interpolate(spark, d):
    y = t(spark, d, "orders").filter(F.year("o_orderdate") != 1995).groupBy(F.col("o_orderpriority").alias("area"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return series.fill_gap(series.complete(y, ["area"], series.years(spark, 1992, 1998)), ["area"], "year", "n")


@query("SELECT 'l_quantity' AS \"column\", count(l_quantity)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), min(l_tax), max(l_tax) FROM lineitem")
def described_columns(spark, d):
    return aggregates.described(t(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumns({"mean": r("mean"), "std": r("std")})


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(19, floor((value - lo) / ((hi - lo) / 20)))::INT AS bin, lo, hi FROM events, e WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS hi, count(*)::BIGINT AS n FROM b GROUP BY bin, b.lo, b.hi""")
def histogram_20(spark, d):
    return bins.histogram(t(spark, d, "events"), "value").withColumns({"lo": r("lo"), "hi": r("hi")})


@query("SELECT event_type, n FROM (SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)")
def tally_map(spark, d):
    return aggregates.tally_map(t(spark, d, "events"), "event_type").select(F.explode("tally").alias("event_type", "n"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT l_returnflag, l_linestatus, measure, round(value, 4) AS value FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2) ON quantity, discount INTO NAME measure VALUE value)")
def wide_to_long(spark, d):
    wide = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return reshape.wide_to_long(wide, ["l_returnflag", "l_linestatus"], ["quantity", "discount"], "measure", "value").withColumn("value", r("value", 4))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'X')::BIGINT AS \"X\" FROM orders GROUP BY 1")
def long_to_wide_domain(spark, d):
    return reshape.long_to_wide(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "X"], F.count(F.lit(1)), 0)


@query("SELECT r_regionkey::INT AS key, r_name AS name, NULL::INT AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stack_missing_columns(spark, d):
    a = t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return reshape.stack([a, b])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, d):
    return selection.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w), 8) AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def min_max_scaled(spark, d):
    return reshape.min_max_scaled(t(spark, d, "part"), ["p_brand"], "p_retailprice", "scaled").select("p_partkey", r("scaled", 8).alias("scaled"))


@query("SELECT 'has_price' AS \"check\", count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false))::BIGINT AS failures FROM orders UNION ALL SELECT 'recent', count(*) FILTER (WHERE NOT coalesce(o_orderdate >= DATE '1995-01-01', false)) FROM orders")
def integrity_checks(spark, d):
    return semantics.expect(t(spark, d, "orders"), {"has_price": F.col("o_totalprice") > 0, "recent": F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")})


@query("""SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click'""")
def differs_keeps_missing(spark, d):
    return t(spark, d, "events").filter(semantics.differs(F.col("event_type"), "click")).select("event_id")


NORMED = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings)
"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings")


POOLED = """WITH f AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, sum(x * {w}) / sum({w}) AS m FROM f GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1),
p AS (SELECT m.label, i, m / n AS x FROM m JOIN n ON m.label = n.label)
"""


@query(POOLED.format(w="1.0") + "SELECT label, (i - 1)::INT AS i, round(x, 6) AS x FROM p")
def pool_mean(spark, d):
    out = documents.pooled_by(_vectors(spark, d), "label", "embedding", "mean")
    return out.select("label", F.posexplode("pooled").alias("i", "x")).withColumn("x", r("x"))


@query(POOLED.format(w="(vec_id % 7 + 1)") + "SELECT label, (i - 1)::INT AS i, round(x, 6) AS x FROM p")
def pool_weighted(spark, d):
    out = documents.pooled_by(_vectors(spark, d).withColumn("n_tokens", F.col("vec_id") % 7 + 1), "label", "embedding", "weighted")
    return out.select("label", F.posexplode("pooled").alias("i", "x")).withColumn("x", r("x"))


PAIRS = POOLED.format(w="1.0") + """, s AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS similarity FROM p a JOIN p b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2)
"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return documents.pooled_by(_vectors(spark, d), "label", "embedding", "mean")


@query(PAIRS + "SELECT a, b, round(similarity, 6) AS similarity FROM s")
def pair_cosine(spark, d):
    return documents.pair_similarity(_pool(spark, d), "label", "pooled").withColumn("similarity", r("similarity"))


@query(PAIRS + ", o AS (SELECT a, b, similarity FROM s UNION ALL SELECT b, a, similarity FROM s) SELECT a, arg_max(b, similarity) AS nearest, round(max(similarity), 6) AS nearest_value, arg_min(b, similarity) AS farthest, round(min(similarity), 6) AS farthest_value FROM o GROUP BY 1")
def nearest_farthest(spark, d):
    pairs = documents.both_ways(documents.pair_similarity(_pool(spark, d), "label", "pooled"))
    return selection.extremes(pairs, "a", "b", "similarity").withColumns({"nearest_value": r("nearest_value"), "farthest_value": r("farthest_value")})


@query(PAIRS + """SELECT a || ' - ' || b AS pair, (a + b) / 2.0::DOUBLE AS middle, round(1 - similarity, 6) AS distance FROM s WHERE b = (SELECT min(label) FROM p WHERE label > a)""")
def adjacent_drift(spark, d):
    labelled = _pool(spark, d).withColumn("name", F.col("label").cast("string"))
    return documents.adjacent_drift(labelled, "label", "name", "pooled").withColumn("distance", r("distance"))


@query(PAIRS + "SELECT label, round(1 - coalesce(similarity, 1), 6) AS distance FROM (SELECT DISTINCT label FROM p) LEFT JOIN s ON b = label AND a = (SELECT min(label) FROM p)")
def baseline_drift(spark, d):
    return documents.baseline_drift(_pool(spark, d), "label", "pooled").select("label", F.abs(r("distance")).alias("distance"))


@query(PAIRS + ", o AS (SELECT a, b, similarity FROM s UNION ALL SELECT b, a, similarity FROM s) SELECT 'e' || (a // 3) AS era_a, 'e' || (b // 3) AS era_b, round(avg(similarity), 6) AS similarity FROM o GROUP BY 1, 2")
def era_means(spark, d):
    pool = _pool(spark, d)
    eras = pool.select("label", F.concat(F.lit("e"), F.floor(F.col("label") / 3).cast("int")).alias("era"))
    return documents.era_means(documents.pair_similarity(pool, "label", "pooled"), eras, "label").withColumn("similarity", r("similarity"))


@query(NORMED + """, f AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), q AS (SELECT label, sum(s * s) AS q FROM (SELECT label, i, sum(x) AS s FROM f GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY 1) SELECT n.label, n, round(CASE WHEN n < 2 THEN 1 ELSE (q - n) / (n * (n - 1)) END, 6) AS coherence FROM n JOIN q ON n.label = q.label""")
def coherence(spark, d):
    return documents.coherence(_vectors(spark, d), "label", "embedding").withColumn("coherence", r("coherence"))


def _strategy(name: str, pool: str) -> str:
    """A pooling strategy's vectors and pairs as SQL tables ``{name}p`` and ``{name}s``."""
    return f"""{name}n AS (SELECT label, sqrt(sum(m * m)) AS n FROM {pool} GROUP BY 1),
{name}p AS (SELECT q.label, i, m / n AS x FROM {pool} q JOIN {name}n USING (label)),
{name}s AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS similarity FROM {name}p a JOIN {name}p b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2)"""


@query(f"""WITH f AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
wm AS (SELECT label, i, sum(x * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1) AS m FROM f GROUP BY 1, 2), mm AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2),
fm AS (SELECT label, i, arg_min(x, vec_id) AS m FROM f GROUP BY 1, 2), {_strategy("w", "wm")}, {_strategy("m", "mm")}, {_strategy("f", "fm")},
o AS (SELECT 'mean' AS strategy, a, b, similarity FROM ms UNION ALL SELECT 'first', a, b, similarity FROM fs)
SELECT strategy, round(avg(o.similarity - w.similarity), 6) AS mean_difference, round(corr(o.similarity, w.similarity), 6) AS correlation
FROM o JOIN ws w ON o.a = w.a AND o.b = w.b GROUP BY 1""")
def strategy_differences(spark, d):
    v = _vectors(spark, d).withColumns({"n_tokens": F.col("vec_id") % 7 + 1, "chunk_idx": F.col("vec_id")})
    pairs = {s: documents.pair_similarity(documents.pooled_by(v, "label", "embedding", s), "label", "pooled") for s in ("weighted", "mean", "first")}
    out = documents.strategy_differences(pairs, "weighted")
    return out.withColumns({"mean_difference": r("mean_difference"), "correlation": r("correlation")})


@query()
def principal_coordinates(spark, d):
    return documents.projected(_vectors(spark, d), "vec_id", "embedding")


@query("""WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2)
SELECT max(i)::BIGINT AS components, round(sum(c) FILTER (i = j), 8) AS variance, round(sum(c * c), 8) AS squares FROM c""")
def explained_variance(spark, d):
    """Sums of the components' variances and of their squares: the covariance's trace and squared norm."""
    out = documents.explained_variance(_vectors(spark, d), "embedding")
    return out.agg(F.count("*").alias("components"), r(F.sum("variance"), 8).alias("variance"), r(F.sum(F.col("variance") * F.col("variance")), 8).alias("squares"))


@query()
def version_merges(spark, d):
    """Ward's merges of the labels' mean vectors; tested on points whose tree is known."""
    keys, distances = documents.distance_matrix(documents.pooled(_vectors(spark, d), "label", "embedding"), "label", "pooled")
    rows = [(int(a), int(b), float(h), int(n)) for a, b, h, n in documents.ward(distances)]
    return spark.createDataFrame(rows, "a int, b int, height double, size int")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", documents.content_hash(F.col("text")).alias("hash"))


@query(r"""WITH RECURSIVE marks AS (SELECT doc_id, text, list_filter([E'\n## ', E'\n### ', E'\n# ', E'\n\n', E'\n'], lambda m: contains(text, m))[1] AS mark
  FROM documents WHERE text <> ''),
parts AS (SELECT doc_id, unnest(CASE WHEN mark IS NULL THEN [text] ELSE string_split(text, mark) END) AS part, mark,
  unnest(CASE WHEN mark IS NULL THEN [1] ELSE range(1, len(string_split(text, mark)) + 1) END) AS i FROM marks),
p AS (SELECT doc_id, i, part, length(part) // 4 AS n FROM (SELECT doc_id, i, CASE WHEN i > 1 THEN ltrim(mark, chr(10)) || part ELSE part END AS part FROM parts)),
packed(doc_id, i, size, waits, g, kept, cut) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, false, 0, false, false FROM marks
  UNION ALL
  SELECT k.doc_id, p.i, CASE WHEN n > 500 THEN 0 WHEN waits AND size + n <= 500 THEN size + n ELSE n END,
    n <= 500 AND (part <> '' OR (waits AND size + n <= 500)), CASE WHEN waits AND size + n <= 500 THEN g ELSE g + 1 END,
    part <> '' OR (waits AND size + n <= 500), n > 500
  FROM packed k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i + 1),
whole AS (SELECT k.doc_id, g, bool_or(cut) AS cut, sum(n)::INT AS n, string_agg(part, chr(10) || chr(10) ORDER BY p.i) AS chunk
  FROM packed k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i WHERE kept GROUP BY 1, 2),
pieces AS (SELECT doc_id, g, cut, n, unnest(CASE WHEN cut THEN list_transform(range(0, length(chunk), 2000), lambda a: substring(chunk, a + 1, 2000)) ELSE [chunk] END) AS chunk,
  unnest(CASE WHEN cut THEN range(0, length(chunk), 2000) ELSE [0] END) AS place FROM whole)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, place) - 1)::INT AS chunk_idx, CASE WHEN cut THEN length(chunk) // 4 ELSE n END::INT AS n_tokens,
  substr(sha256(chunk), 1, 16) AS hash FROM pieces""")
def chunked_documents(spark, d):
    """Chunks of at most 500 tokens."""
    out = documents.chunked(t(spark, d, "documents"), "doc_id", "text", 500)
    return out.select("doc_id", "chunk_idx", "n_tokens", documents.content_hash(F.col("text")).alias("hash"))


_WAGES = ", ".join(f"({y}, {w}::DOUBLE)" for y, w in wages.PROJECTED)


def _exact(x: str) -> str:
    """SQL for rounding to cents by the stored binary value, halves to even."""
    return (
        f"(SELECT (l + CASE WHEN o > 0 THEN 1 WHEN o < 0 THEN 0 ELSE l % 2 END) / 100.0::DOUBLE FROM (SELECT floor(p) AS l, (p - floor(p) - 0.5::DOUBLE) + ((h * 100.0::DOUBLE - p) + (x - h) * 100.0::DOUBLE) AS o "
        f"FROM (SELECT x, x * 100.0::DOUBLE AS p, x * 134217729.0::DOUBLE - (x * 134217729.0::DOUBLE - x) AS h FROM (SELECT {x} AS x))))"
    )


SCENARIOS = f"""WITH w(year, f) AS (VALUES {_WAGES}), o(option) AS (VALUES ('A'), ('B'), ('C'), ('D')),
x AS (SELECT option, year, f, least(CASE option WHEN 'A' THEN 3.02::DOUBLE WHEN 'B' THEN 3.02::DOUBLE * (f / 16.82::DOUBLE)
  WHEN 'C' THEN CASE WHEN year <= 2029 THEN f - 13.80::DOUBLE ELSE (20.15::DOUBLE - 13.80::DOUBLE) * (f / 20.15::DOUBLE) END ELSE f * 0.20::DOUBLE END, f * 0.25::DOUBLE) AS off FROM w, o),
s AS (SELECT option, year::INT AS year, f AS "full", {_exact("off")} AS "offset", {_exact("f - off")} AS tipped FROM x)
"""


@query(SCENARIOS + """SELECT 'r' || r_regionkey AS region, s.* FROM s, region""")
def scenario_offsets(spark, d):
    regions = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("region"))
    return regions.crossJoin(wages.scenarios(wages.projected(spark)))


FREEZES = SCENARIOS + """, a AS (SELECT year, tipped AS a, round(tipped - lag(tipped) OVER (ORDER BY year), 2) AS step FROM s WHERE option = 'A'),
z AS (SELECT a AS a30, round(step * 1.025::DOUBLE, 2) AS s31, round(round(step * 1.025::DOUBLE, 2) * 1.025::DOUBLE, 2) AS s32 FROM a WHERE year = 2030),
v(variant, freeze_year, level, catch_up) AS (VALUES ('E1a', 2026, 13.80::DOUBLE, false), ('E1b', 2026, 13.80::DOUBLE, true), ('E2a', 2027, 15.15::DOUBLE, false), ('E2b', 2027, 15.15::DOUBLE, true)),
g AS (SELECT v.*, (2025 + i)::INT AS year FROM v, range(8) t(i)),
f AS (SELECT g.*, a.a, a30, s31, sum(CASE WHEN g.year < 2029 THEN 0 WHEN g.year = 2031 THEN s31 WHEN g.year = 2032 THEN s32 ELSE step END) OVER (PARTITION BY variant ORDER BY g.year) AS run FROM g LEFT JOIN a ON g.year = a.year, z),
v5 AS (SELECT variant, year, round(CASE WHEN year < freeze_year THEN coalesce(a, level) WHEN year <= 2028 THEN level WHEN catch_up THEN coalesce(a, a30 + s31 * (year - 2030)) ELSE level + run END, 2) AS tipped FROM f)
"""


@query(FREEZES + "SELECT variant, year, tipped FROM v5")
def freeze_variants(spark, d):
    return wages.freeze_variants(wages.projected(spark)).withColumn("tipped", r("tipped", 2))


_SCHEDULE = ", ".join(f"({y}, {a}::DOUBLE, {b}::DOUBLE)" for y, a, b in wages.SCHEDULE)


@query(f"""WITH w(year, f, tp) AS (VALUES {_SCHEDULE}) SELECT n_name, year::INT AS year, round(1000 + n_nationkey * 10 * 1.035::DOUBLE ** (year - 2023), 7) AS rent,
  round((1000 + n_nationkey * 10 * 1.035::DOUBLE ** (year - 2023)) * 12 / 0.30::DOUBLE / 2080, 8) AS needed,
  round((1000 + n_nationkey * 10 * 1.035::DOUBLE ** (year - 2023)) * 12 / 0.30::DOUBLE / 2080 - f, 8) AS gap_full,
  round((1000 + n_nationkey * 10 * 1.035::DOUBLE ** (year - 2023)) * 12 / 0.30::DOUBLE / 2080 - tp, 8) AS gap_tipped FROM nation, w""")
def affordability_gap(spark, d):
    schedule = wages.schedule(spark).select("year", "full", "tipped")
    grown = wages.grown_rent(F.col("n_nationkey") * 10.0, F.col("year"))
    rents = t(spark, d, "nation").crossJoin(schedule.select("year")).select("n_name", "year", (F.lit(1000) + grown).alias("rent"))
    out = wages.affordability(rents, schedule)
    return out.select("n_name", "year", r("rent", 7).alias("rent"), *[r(c, 8).alias(c) for c in ("needed", "gap_full", "gap_tipped")])


@query("""SELECT c_custkey, hours::DOUBLE AS hours, round((10 + c_custkey % 9) * hours * 52, 2) AS annual, round((10 + c_custkey % 9) * hours * 52.0::DOUBLE / ((15.15::DOUBLE + 6.99::DOUBLE) * 52), 6) AS break_even
FROM customer, (VALUES (25), (30), (35)) h(hours)""")
def break_even_hours(spark, d):
    rates = t(spark, d, "customer").select("c_custkey", (10 + F.col("c_custkey") % 9).alias("rate"))
    table = wages.hours_table(rates, [25, 30, 35])
    return table.select("c_custkey", "hours", r("annual", 2).alias("annual"), r(wages.break_even_hours(F.col("annual"), F.lit(15.15), F.lit(6.99))).alias("break_even"))


@query("""WITH b AS (SELECT o_custkey % 50 AS area, count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 10 = 1) AS b, count(*) FILTER (WHERE o_orderkey % 10 = 2) AS c, count(*) FILTER (WHERE o_orderkey % 10 = 3) AS d FROM orders GROUP BY 1)
SELECT area, total, (a + b + c + d)::BIGINT AS cost_burdened, (c + d)::BIGINT AS severely_burdened, round((a + b + c + d)::DOUBLE / total, 8) AS pct_burdened, round((c + d)::DOUBLE / total, 8) AS pct_severely FROM b""")
def cost_burden(spark, d):
    k = lambda i: F.count_if(F.col("o_orderkey") % 10 == i)
    brackets = t(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("area")).agg(F.count("*").alias("total"), k(0).alias("b30_35"), k(1).alias("b35_40"), k(2).alias("b40_50"), k(3).alias("b50_plus"))
    out = wages.cost_burden(brackets)
    return out.select("area", "total", "cost_burdened", "severely_burdened", r("pct_burdened", 8).alias("pct_burdened"), r("pct_severely", 8).alias("pct_severely"))


def _uniform(stream: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('/', sim, '{stream}', '42')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _normal(stream: int) -> str:
    return f"(sqrt(-2 * ln({_uniform(2 * stream)})) * cos(2 * pi() * {_uniform(2 * stream + 1)}))"


_TRIES = ", ".join(f"30 + 6 * {_normal(1 + 50 * k)}" for k in range(12))
_TIP = "ln(10::DOUBLE) - ln(1 + 0.7::DOUBLE * 0.7::DOUBLE) / 2 + sqrt(ln(1 + 0.7::DOUBLE * 0.7::DOUBLE))"
_POINTS = (10, 25, 50, 75, 90)


@query(FREEZES + f""", d AS (SELECT unnest(range({wages.SIMULATIONS})) AS sim),
tries AS (SELECT sim, [{_TRIES}] AS h FROM d),
drawn AS (SELECT coalesce(list_filter(h, lambda x: x >= 15 AND x <= 45)[1], greatest(15, least(45, h[1]))) AS hours,
  greatest(0, least(0.10::DOUBLE, 0.035::DOUBLE + 0.015::DOUBLE * {_normal(2)})) AS growth, exp({_TIP} * {_normal(4)}) AS tips FROM tries),
plan AS (SELECT option AS scenario, year, tipped FROM s WHERE option IN ('A', 'C') UNION ALL SELECT variant, year, tipped FROM v5 WHERE variant IN ('E1a', 'E1b', 'E2a')),
lived AS (SELECT scenario, year, (tipped + tips) * hours * 52 AS income, 1915 * (1 + growth) ** (year - 2023) * 12 / 0.30::DOUBLE AS needed FROM drawn, plan)
SELECT scenario, year, {", ".join(f"round(quantile_cont(income, {p / 100}), 6) AS p{p}" for p in _POINTS)}, round(quantile_cont(needed, 0.5), 6) AS needed_p50,
  round(avg((income < needed)::INT), 6) AS p_unaffordable FROM lived GROUP BY 1, 2""")
def monte_carlo_bands(spark, d):
    """Income bands by scenario and year; a draw follows from its row's id."""
    base = wages.scenarios(wages.projected(spark)).filter("option IN ('A', 'C')").select(F.col("option").alias("scenario"), "year", "tipped")
    freeze = wages.freeze_variants(wages.projected(spark)).filter("variant IN ('E1a', 'E1b', 'E2a')").select(F.col("variant").alias("scenario"), "year", "tipped")
    out = wages.monte_carlo(wages.draws(spark), base.union(freeze), 1915.0, points=_POINTS)
    return out.select("scenario", "year", *[r(c).alias(c) for c in (*[f"p{p}" for p in _POINTS], "needed_p50", "p_unaffordable")])


@query("""SELECT n_name AS metro, round(10 + n_nationkey, 2) AS wage, CASE WHEN n_regionkey < 3 THEN 90 + n_nationkey END AS parity, round((10 + n_nationkey)::DOUBLE / CASE WHEN n_regionkey < 3 THEN 90 + n_nationkey END * 100, 8) AS real FROM nation""")
def real_wages(spark, d):
    n = t(spark, d, "nation")
    pay = n.select(F.col("n_name").alias("metro"), (10 + F.col("n_nationkey")).alias("wage"))
    parity = n.filter("n_regionkey < 3").select(F.col("n_name").alias("metro"), (90 + F.col("n_nationkey")).alias("parity"))
    return wages.real_wages(pay, parity).withColumn("real", r("real", 8))


@query("""WITH h AS (SELECT year(o_orderdate)::INT AS year, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1), m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM h WHERE year BETWEEN 1993 AND 1997)
SELECT (1998 + k)::INT AS year, (1000 + 50 * k)::DOUBLE AS x, round(i + s * (1000 + 50 * k), 2) AS forecast FROM m, range(6) t(k)""")
def enrolment_forecast(spark, d):
    h = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("x"), F.sum("o_totalprice").alias("y"))
    plan = spark.range(6).select((1998 + F.col("id")).cast("int").alias("year"), (1000.0 + 50 * F.col("id")).alias("x"))
    return people.enrolment_forecast(h, plan, "x", "y", 1993, 1997).withColumn("forecast", r("forecast", 2))


@query("""WITH p AS (SELECT c_nationkey AS place, year(o_orderdate)::INT AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
q AS (SELECT n_regionkey AS county, year, sum(value) AS value FROM p JOIN nation ON place = n_nationkey GROUP BY 1, 2),
a AS (SELECT place, max(value) FILTER (WHERE year = 1997) / max(value) FILTER (WHERE year = 1993) - 1 AS g FROM p GROUP BY 1), b AS (SELECT county, max(value) FILTER (WHERE year = 1997) / max(value) FILTER (WHERE year = 1993) - 1 AS g FROM q GROUP BY 1)
SELECT n_nationkey AS place, n_regionkey AS county, round(a.g, 8) AS place_growth, round(b.g, 8) AS county_growth, round(a.g / b.g, 5) AS ratio FROM nation LEFT JOIN a ON n_nationkey = place LEFT JOIN b ON n_regionkey = county""")
def sister_growth(spark, d):
    n = t(spark, d, "nation")
    places = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("place"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    catalogue = n.select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("county"))
    counties = places.join(F.broadcast(catalogue), "place").groupBy("county", "year").agg(F.sum("value").alias("value"))
    out = people.sister_growth(places, counties, catalogue, 1993, 1997)
    return out.select("place", "county", r("place_growth", 8).alias("place_growth"), r("county_growth", 8).alias("county_growth"), r("ratio", 5).alias("ratio"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    counts = t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT o_orderkey, array_to_string(list_filter(string_split('a; b; c', '; '), lambda x: x <> CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'z' END), '; ') AS chosen FROM orders")
def multi_select_toggle(spark, d):
    start = F.split(F.lit("a; b; c"), "; ")
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.when(F.col("o_orderkey") % 2 == 0, reshape.toggled(start, "a", "none")).otherwise(start), "; ").alias("chosen"))
