"""The composed analyses on hand-made and independent values."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from townhall.operators import aggregates
from townhall.plans import budget, documents, panels, people, survey, votes, wages
from townhall.sources import readers, writers
from townhall.streaming import tally


def test_vote_share_forecast(spark):
    wide = spark.createDataFrame([("A", 60, 130, 210), ("B", 40, 70, 90)], ["name", "11/4/25 19:00", "11/4/25 21:30", "11/5/25 9:15"])
    ballots = spark.createDataFrame([("2025-11-04 19:00:00", 100), ("2025-11-04 21:30:00", 200), ("2025-11-05 09:15:00", 300)], "ts string, ballots int").withColumn("ts", F.to_timestamp("ts"))
    shared = votes.shares(votes.counts_to_long(wide, "name"), "name", ballots)
    out = {r.name: r for r in votes.final_forecast(shared, "name", 400).collect()}
    slope, intercept = np.polyfit([100, 200, 300], [0.6, 0.65, 0.7], 1)
    assert out["A"].forecast == pytest.approx(intercept + 400 * slope)
    assert out["A"].final == pytest.approx(0.7)
    quality = votes.forecast_quality(votes.final_forecast(shared, "name", 400)).first()
    assert quality.max_abs_error == pytest.approx(0.05)
    steps = votes.reference_cumulative_error(shared, "name", 400).filter("name = 'A'").orderBy("points").collect()
    assert [r.points for r in steps] == [2, 3]
    assert steps[1].error == pytest.approx(0.7 - 0.75)


def test_regression_inference(spark):
    rng = np.random.default_rng(1)
    x = np.arange(20.0)
    y = 3 * x + rng.standard_normal(20)
    out = aggregates.linreg_inference(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y")
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - slope * x - intercept
    assert out["slope"] == pytest.approx(slope) and out["intercept"] == pytest.approx(intercept)
    assert out["stderr"] == pytest.approx(np.sqrt((rest**2).sum() / 18 / ((x - x.mean()) ** 2).sum()))
    assert out["p"] < 1e-10


def test_turnout(spark):
    voters = spark.createDataFrame([(1, 1970, 2012), (2, 1990, 2010), (3, 1990, 2010)], "voter_id int, birth_year int, registered int")
    history = spark.createDataFrame([(1, 2010, "General"), (1, 2012, None), (1, 2012, "General"), (2, 2012, "Primary"), (2, 2013, "General"), (9, 2012, "General")], "voter_id int, year int, kind string")
    got = {(r.age_bin, r.cycle): r.turnout for r in people.turnout(voters, history, [2012, 2013]).collect()}
    assert len(got) == 12
    assert got["35-44", "Even"] == 2.0 and got["35-44", "Odd"] == 0.0
    assert got["18-24", "Odd"] == 1.0 and got["18-24", "Even"] == 0.0
    assert got["65-109", "Odd"] is None
    assert [r.voter_id for r in people.unmatched(history, voters).collect()] == [9]


def test_cohorts(spark):
    wide = spark.createDataFrame([(2000, 10, 20, 30), (2001, 11, 12, 25), (2002, 9, 14, 15)], "year int, k int, g1 int, g2 int")
    got = {(r.start_year, r.transition): r.change for r in people.cohort_progression(wide, ["k", "g1", "g2"], 2000).collect()}
    assert got == {(2000, "k-g1"): 2, (2000, "g1-g2"): 3, (2001, "k-g1"): 3}


def test_wage_scenarios(spark):
    got = {(r.option, r.year): (r.offset, r.tipped) for r in wages.scenarios(wages.projected(spark)).collect()}
    assert got["A", 2028] == (3.02, 16.45) and got["A", 2029] == (3.02, 17.13) and got["A", 2030] == (3.02, 17.84)
    assert got["C", 2025] == (3.02, 13.8)
    full = {y: w for y, w in wages.PROJECTED}
    for y, w in full.items():
        assert got["B", y][0] == round(min(3.02 * (w / full[2025]), w * 0.25), 2)
        assert got["D", y] == (round(w * 0.2, 2), round(w - w * 0.2, 2))
        assert got["C", y][1] == round(w - min(w - 13.8 if y <= 2029 else (full[2029] - 13.8) * (w / full[2029]), w * 0.25), 2)
    v = {(r.variant, r.year): r.tipped for r in wages.freeze_variants(wages.projected(spark)).collect()}
    assert v["E1a", 2026] == 13.8 and v["E1a", 2029] == 14.48 and v["E1a", 2030] == 15.19 and v["E1a", 2031] == 15.92 and v["E1a", 2032] == 16.67
    assert v["E2a", 2026] == 15.15 and v["E2b", 2029] == 17.13 and v["E1b", 2032] == pytest.approx(17.84 + 2 * 0.73)


def test_monte_carlo(spark):
    drawn = wages.draws(spark, 8000).cache()
    s = drawn.agg(F.min("hours"), F.max("hours"), F.avg("hours"), F.avg("tips_moderate"), F.min("rent_growth"), F.max("rent_growth"), F.avg("rent_growth")).first()
    assert 15 <= s[0] and s[1] <= 45 and s[2] == pytest.approx(30, abs=0.3) and s[3] == pytest.approx(10, rel=0.05)
    assert 0 <= s[4] and s[5] <= 0.1 and s[6] == pytest.approx(0.035, abs=0.001)
    again = wages.draws(spark, 8000).repartition(7)
    assert drawn.exceptAll(again).count() == 0
    plan = spark.createDataFrame([("A", 2028, 16.45), ("C", 2028, 14.6)], "scenario string, year int, tipped double")
    out = {r.scenario: r for r in wages.monte_carlo(drawn, plan, 1915.0).collect()}
    assert out["A"].p10 < out["A"].p50 < out["A"].p90 and out["A"].p_unaffordable < out["C"].p_unaffordable


def _pool(spark, n=400):
    options = {"tenure": {"Own": 0.6, "Rent": 0.3, "Other": 0.05, "Prefer not to say": 0.05}, "age": {"18-34": 0.2, "35-64": 0.5, "65 and over": 0.3}}
    return survey.synthetic_pool(spark, n, options).withColumn("age", F.when(F.col("respondent") % 17 != 0, F.col("age")))


def test_raking_against_a_row_loop(spark):
    targets = {"tenure": {"Own": 0.48, "Rent": 0.52}, "age": {"18-34": 0.45, "35-64": 0.35, "65 and over": 0.2}}
    pool = _pool(spark)
    rows = pool.orderBy("respondent").collect()
    w = np.ones(len(rows))
    for _ in range(50):
        before = w.copy()
        for c, goal in targets.items():
            real = np.array([r[c] is not None and r[c] != "Prefer not to say" for r in rows])
            whole = w[real].sum()
            mass = {k: w[[bool(x) and r[c] == k for x, r in zip(real, rows)]].sum() / whole for k in goal}
            for k, share in goal.items():
                if mass[k] > 0:
                    w[[r[c] == k for r in rows]] *= share / mass[k]
        w *= len(w) / w.sum()
        if np.abs(w - before).max() < 1e-6:
            break
    w = np.clip(w, max(np.quantile(w, 0.02), 0.2), 5.0)
    w *= len(w) / w.sum()
    got = [r.weight for r in survey.raked(pool, targets).orderBy("respondent").collect()]
    assert got == pytest.approx(list(w), rel=1e-9)
    n_eff = survey.raked(pool, targets).agg(aggregates.effective_n(F.col("weight")).alias("n")).first().n
    assert n_eff == pytest.approx(w.sum() ** 2 / (w**2).sum()) and n_eff <= len(w)


def test_draws_that_depend_on_an_earlier_answer(spark):
    choices = {"tenure": {"owns": 3, "rents": 1}, "vote": {"yes": 1, "no": 1}}
    free = survey.synthetic_pool(spark, 20_000, choices)
    bound = survey.synthetic_pool(spark, 20_000, choices, given={"vote": ("tenure", {"rents": {"yes": 0.9, "no": 0.1}})})
    share = lambda df: {r[0]: r[1] for r in df.groupBy("tenure").agg(F.avg((F.col("vote") == "yes").cast("int"))).collect()}
    assert share(free) == pytest.approx({"owns": 0.5, "rents": 0.5}, abs=0.03)
    assert share(bound) == pytest.approx({"owns": 0.5, "rents": 0.9}, abs=0.03)
    assert free.select("respondent", "tenure").exceptAll(bound.select("respondent", "tenure")).count() == 0
    assert free.filter("tenure = 'owns'").exceptAll(bound).count() == 0


def test_chi2_grid_is_a_screen_of_each_pair(spark):
    rows = [(["a", "b", "c", "Prefer not to say", None][i % 5], ["x", "y"][i % 2], (i * 7) % 11 < 4 + i % 3, ["u", "v", None][i * i % 3]) for i in range(400)] + [("rare", "x", True, "u")] * 3
    df = spark.createDataFrame(rows, "g string, h string, flag boolean, w string")
    found = {(r["item"], r.outcome): r for r in survey.chi2_grid(df, ["g", "h"], ["flag", "w"]).collect()}
    for g in "gh":
        for b in ("flag", "w"):
            want = survey.chi2_screen(df, g, b)
            assert found[g, b].dof == want["dof"]
            assert [found[g, b].chi2, found[g, b].p] == pytest.approx([want["chi2"], want["p"]])
    assert survey.chi2_grid(df.filter("h = 'x'"), ["h"], ["w"]).count() == 0
    assert survey.chi2_grid(df.limit(0), ["g", "h"], ["w"]).count() == 0


def test_chi2_screen(spark):
    rows = [("a", True)] * 30 + [("a", False)] * 20 + [("b", True)] * 10 + [("b", False)] * 40 + [("few", True)] * 3 + [("Prefer not to say", True)] * 50
    out = survey.chi2_screen(spark.createDataFrame(rows, "g string, b boolean"), "g", "b")
    n = np.array([[30, 20], [10, 40]], float)
    e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
    assert out["dof"] == 1 and out["chi2"] == pytest.approx(((np.abs(n - e) - 0.5) ** 2 / e).sum())
    assert survey.chi2_screen(spark.createDataFrame(rows[:50], "g string, b boolean"), "g", "b") is None
    wide = [("a", "x")] * 20 + [("a", "y")] * 5 + [("b", "y")] * 15 + [("b", "z")] * 12
    out = survey.chi2_screen(spark.createDataFrame(wide, "g string, b string"), "g", "b")
    n = np.array([[20, 5, 0], [0, 15, 12]], float)
    e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
    assert out["dof"] == 2 and out["chi2"] == pytest.approx(((n - e) ** 2 / e).sum())
    same = spark.createDataFrame([("a", "x")] * 20 + [("b", "x")] * 20, "g string, b string")
    assert survey.chi2_screen(same, "g", "b") == {"chi2": 0.0, "dof": 0, "p": 1.0}


def test_post_stratification(spark):
    df = spark.createDataFrame([("Own",), ("Own",), ("Rent",), ("Other",), ("Prefer not to say",), (None,)], "t string")
    got = sorted(((r.t or "", r.weight) for r in survey.post_stratified(df, "t", {"Own": 0.5, "Rent": 0.5}).collect()), key=str)
    assert got == sorted([("Own", 1.0), ("Own", 1.0), ("Rent", 2.0), ("Other", 1.0), ("Prefer not to say", None), ("", None)], key=str)


SUBMISSION = ", ".join([*(f"gf_{k} double" for k in budget.DEPARTMENTS), *(f"rev_{k} double" for k in budget.REVENUE), "reserves double", "demo_age string"])


def _submission(**changes):
    row = dict.fromkeys([*(f"gf_{k}" for k in budget.DEPARTMENTS), *(f"rev_{k}" for k in budget.REVENUE)], 0.0) | {"reserves": 0.0, "demo_age": "x"}
    return tuple((row | changes).values())


def test_budget_score(spark):
    rows = [_submission(gf_police=-20.0, gf_fire=-5.0, rev_fees=10.0, reserves=1.0), _submission(), _submission(rev_sales=None, gf_police=5.0)]
    a, b, c = budget.scored(spark.createDataFrame(rows, SUBMISSION)).collect()
    assert a.net_cuts == pytest.approx(50.2 * 0.2 + 29.1 * 0.05) and a.top_cut == "police" and a.balanced
    assert a.remaining_2026 == pytest.approx(7.5 - a.net_cuts - 1.23 - 1) and a.remaining_2027 == pytest.approx(6.5 - a.net_cuts - 1.23)
    assert b.top_cut is None and not b.balanced and b.rev_share == 0
    assert c.spend_change == pytest.approx(2.51) and c.used_vote is False
    assert sum(budget.DEPARTMENTS.values()) == pytest.approx(194.5)
    assert sum(budget.LOCKED.values()) == pytest.approx(326.5)


def test_validation(spark):
    rows = [_submission(), _submission(gf_police=26.0, reserves=-1.0), _submission(demo_age=None), _submission(rev_fees=None)]
    good, bad = budget.validated(spark.createDataFrame(rows, SUBMISSION), ["demo_age"])
    assert good.count() == 2
    assert sorted(map(tuple, (r.broken for r in bad.collect()))) == [("answered",), ("gf_in_range", "reserves_in_range")]


def test_stream_keeps_the_tally(spark, tmp_path):
    rows = budget.stored(budget.scored(spark.createDataFrame([_submission(gf_police=-20.0, rev_fees=10.0), _submission(gf_fire=-9.0, reserves=2.0), _submission(gf_police=99.0)], SUBMISSION)))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    folder = str(tmp_path / "in")
    rows.write.mode("append").json(folder)
    places = {k: str(tmp_path / k) for k in ("log", "tally", "checkpoint", "rejected")}

    def run():
        tally.keep_tally(tally.read_submissions(spark, folder, schema), ["demo_age"], places["log"], places["tally"], places["checkpoint"], places["rejected"]).awaitTermination()
        return spark.read.parquet(places["tally"]).first()

    assert run().n == 2
    rows.limit(1).write.mode("append").json(folder)
    got = run()
    want = budget.public_tally(budget.validated(rows, ["demo_age"])[0].union(rows.limit(1))).first()
    assert got.n == want.n == 3 and got.cutTally == want.cutTally == {"police": 2, "fire": 1} and got.revShareSum == pytest.approx(want.revShareSum)
    assert spark.read.parquet(places["rejected"]).count() == 1
    shown = budget.tally_display(spark.read.parquet(places["tally"])).first()
    assert shown.topCut == "police" and shown.usedRevenuePct == pytest.approx(200 / 3)
    assert json.loads(budget.tally_json(spark.read.parquet(places["tally"])).first().agg)["cutTally"] == {"police": 2, "fire": 1}


def test_empty_tally(spark):
    none = budget.stored(budget.scored(spark.createDataFrame([_submission()], SUBMISSION).limit(0)))
    row = budget.public_tally(none).first()
    assert row.n == 0 and row.cutTally == {} and row.revShareSum == 0
    assert budget.tally_display(budget.public_tally(none)).first().topCut is None


def test_chunks():
    body = "intro\n## one\n" + "a" * 100 + "\n## two\n" + "b" * 500
    assert documents.sections(body)[1].startswith("## one") and documents.sections("plain") == ["plain"]
    fixed = documents.packed_chunks(body, 50)
    assert all(n <= 50 for _, n in fixed) and "".join(t for t, _ in fixed).count("b") == 500
    old = documents.packed_chunks(body, 50, mode="reference")
    assert max(n for _, n in old) > 50 and "".join(t for t, _ in old).count("b") == 500
    assert [t for t, _ in documents.packed_chunks("x" * 1000, 50, mode="reference")] == ["x" * 200] * 5
    assert documents.packed_chunks("", 50) == []
    assert documents.packed_chunks("a\n\nb", 50) == [("a\n\nb", 0)]


def test_embedding_cache_and_pooling(spark):
    chunks = spark.createDataFrame([("d", 0, "one", 1, [3.0, 0.0]), ("d", 1, "two", 3, [0.0, 1.0])], "key string, chunk_idx int, text string, n_tokens int, vector array<double>")
    cache = chunks.limit(1).select(documents.content_hash(F.col("text")).alias("hash"), F.col("vector").alias("cached"))
    hits, misses = documents.cache_split(chunks, cache)
    assert hits.count() == 1 and misses.first().text == "two"
    got = {k: documents.pooled_by(chunks, "key", "vector", k).first().pooled for k in ("weighted", "mean", "first")}
    assert got["weighted"] == pytest.approx([2**-0.5, 2**-0.5]) and got["mean"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got["first"] == pytest.approx([1, 0])


def test_projection_and_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    mean, parts, share = documents.principal_components(vectors, "v")
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert share == pytest.approx(values[:2] / values.sum()) and mean == pytest.approx(x.mean(0))
    spread = documents.explained_variance(vectors.union(vectors.select("id", F.lit(None))), "v").collect()
    assert [r.variance for r in spread] == pytest.approx(values / 39) and sum(r.share for r in spread) == pytest.approx(1)
    got = np.array([[r.c1, r.c2] for r in documents.projected(vectors, "id", "v").orderBy("id").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ parts.T) and abs(got.mean()) < 1e-9
    flat = rng.standard_normal((12, 2))
    d = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2))
    placed, stress = documents.mds(d, steps=2000)
    assert stress < 0.5 and placed.shape == (12, 2)
    line = np.abs(np.subtract.outer([0, 1, 10, 11, 30], [0, 1, 10, 11, 30])).astype(float)
    merges = documents.ward(line)
    assert merges[0, :2].tolist() == [0, 1] and merges[1, :2].tolist() == [2, 3] and merges[-1, 3] == 5
    assert merges[2, 2] == pytest.approx(np.sqrt(2 * 2 * 2 / 4) * 10)
    keys, distances = documents.distance_matrix(vectors, "id", "v")
    assert keys == list(range(40)) and np.allclose(distances, distances.T)


def test_wage_panel(spark, tmp_path):
    table = "Some survey\nnote,,,\nAREA,AREA_TITLE,OCC_CODE,OCC_TITLE,TOT_EMP,A_MEAN\n"
    rows = ["1,Springfield,11-1011,Chief,10,*", "1,Springfield,35-3031,Server,20,30000", "2,Elsewhere,11-1011,Chief,5,1"]
    for name, member, text in (
        ("oesm19ma.zip", "msa.csv", table + "\n".join(rows)), ("oes97ma.zip", "msa.txt", table.replace(",", "\t") + "\n".join(r.replace("Springfield", "Nowhere").replace(",", "\t") for r in rows)),
    ):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, text)
            z.writestr("readme.txt", "a,b,c,d,e")
            z.writestr("bad.csv", "no table")
    (tmp_path / "oesm20ma.zip").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    panel, errors = panels.wage_panel(files, panels.metro("springfield", ["1"]))
    got = [(r.year, r.occ_code, r.tot_emp, r.a_mean) for r in panel.collect()]
    assert got == [(1997, "11-1011", "10", "*"), (1997, "35-3031", "20", "30000"), (2019, "11-1011", "10", "*"), (2019, "35-3031", "20", "30000")]
    assert panel.columns[:3] == ["year", "area_code", "area_name"] and errors.count() == 3
    whole, _ = panels.wage_panel(files, panels.national())
    assert whole.filter("area_name = 'U.S.'").count() == 4
    rows_read = readers.zip_rows(files).filter("error IS NULL")
    prov = {r.path.rsplit("/", 1)[-1]: (r.n_rows, r.members) for r in writers.provenance(files, rows_read).collect()}
    assert prov["oesm19ma.zip"] == (6, ["msa.csv"]) and prov["oesm20ma.zip"] == (0, None)
    lines = [r.value for r in writers.dictionary_markdown(writers.data_dictionary(panel)).collect()]
    assert "| Springfield | 2019-2019 | 1 |" in lines


def test_layouts_and_members(spark, tmp_path):
    """Latin-1 members, workbooks, headers that differ by file, blank area names, bad slices."""
    from townhall.round_trips import _archives, _workbook, _zip

    folder = "/root/testdata/sf0.001"
    rows = readers.zip_rows(_archives(spark, folder))
    assert rows.filter("exists(cells, c -> c like '% é')").select("path").distinct().count() == 2
    assert [r.path for r in rows.filter("error IS NOT NULL").collect()] == ["oesm21st.zip"]
    book = spark.createDataFrame([("b.xlsx", bytearray(_workbook([["a", "b"], ["1", ""]]))), ("c.zip", bytearray(_zip({"x.xlsx": b"no book"})))], "path string, content binary")
    got = readers.zip_rows(book).orderBy("path", "row").collect()
    assert [(r.path, r.cells) for r in got[:2]] == [("b.xlsx", ["a", "b"]), ("b.xlsx", ["1", ""])] and got[2].error
    blank = "area_title,occ_code,tot_emp,x\n,11-1,5,\n"
    files = spark.createDataFrame([("oesm19ma.zip", bytearray(_zip({"a.csv": blank.encode()})))], "path string, content binary")
    panel, _ = panels.wage_panel(files, panels.Scope((F.lit(True),), "all", label="Springfield"))
    assert [r.area_name for r in panel.collect()] == ["Springfield"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.csv").write_text("note\na,b\n1,x\n")
    (tmp_path / "p" / "2.csv").write_text("note\nb,c\ny,2\n")
    (tmp_path / "p" / "3.csv").write_text("too short")
    both = readers.read_csv(spark, str(tmp_path / "p"), header=1)
    assert sorted((r.a or "", r.b, r.c or "") for r in both.collect()) == [("", "y", "2"), ("1", "x", "")]
    typed = readers.read_csv(spark, str(tmp_path / "p"), "c INT, a INT, z STRING", header=1)
    assert typed.columns == ["c", "a", "z"] and sorted((r.c or 0, r.a or 0, r.z) for r in typed.collect()) == [(0, 1, None), (2, 0, None)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("preamble\nfips,n\n08013,1\n08014,x\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), header=1)
    assert [tuple(r) for r in df.collect()] == [("08013", "1"), ("08014", "x")]
    typed = readers.read_csv(spark, str(tmp_path / "a.csv"), "fips STRING, n INT", header=1)
    assert [r.n for r in typed.collect()] == [1, None]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"p": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    geo = readers.read_geojson(spark, str(tmp_path / "g.json"), "p string").first()
    assert geo.p == "1" and json.loads(geo.geometry)["type"] == "Point"
    raw = spark.createDataFrame([('[["a","b"],["5","x"]]',), ("broken",)], "raw string")
    assert [tuple(r) for r in raw.select(*readers.header_row_json(F.col("raw"), ["b", "a"])).collect()] == [(None, 5.0), (None, None)]
    fred = spark.createDataFrame([('{"observations":[{"date":"2020-01-01","value":"1.5"},{"date":"2020-02-01","value":"."}]}',)], "raw string")
    assert [r.value for r in readers.observations(fred, "raw").collect()] == [1.5, None]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.md").write_text("hello")
    catalogue = spark.createDataFrame([("x.md", 1977.5), ("missing.md", 1980.0)], "file string, year double")
    assert [r.text for r in readers.read_text_catalogue(spark, str(tmp_path / "t"), catalogue).collect()] == ["hello"]
    names = spark.createDataFrame([("oes97st.zip",), ("oesm24ma.zip",), ("oesn04nat.zip",), ("other.zip",)], "n string")
    assert [r.y for r in names.select(readers.year_in_name(F.col("n")).alias("y")).collect()] == [1997, 2024, 2004, None]
    writers.write_csv(df, str(tmp_path / "out"), ["fips"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    writers.write_nested_json(df, str(tmp_path / "json"), "fips", title=F.lit("t"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"title": "t", "items": [{"fips": "08013", "n": "1"}, {"fips": "08014", "n": "x"}]}
    assert [tuple(r) for r in writers.headline({"rows": F.count("*")}, df).collect()] == [("rows", 2.0)]


def test_order_of_rows_does_not_matter(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0), ("b", 3, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, year int, v double").repartition(3)
    shares = aggregates.share_within(df, ["k"], "v")
    assert sorted(r.share for r in shares.filter("k = 'a'").collect()) == pytest.approx([0.4, 0.6])


def test_quarterly_slices(spark):
    a = spark.createDataFrame([("2019", "10", "722", "5")], "year string, qtr string, code string, n string")
    b = spark.createDataFrame([("2019", "2", "722", "*"), ("2019", "10", "722", "5")], "year string, qtr string, code string, n string")
    assert [(r.qtr, r.n) for r in panels.quarterly([a, b], ["n"], ["year", "qtr", "code"]).collect()] == [("2", None), ("10", 5.0)]
