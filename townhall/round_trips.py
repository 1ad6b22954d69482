"""Queries that write a table in the layouts of the sources, read it back, and compare with SQL; and
queries over operators that the other queries do not reach. They are added to the library's queries."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import semantics
from .operators import aggregates, reshape, selection, series
from .plans import documents, panels, people, wages
from .queries import query, r, t
from .sources import readers, writers
from .streaming import tally


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; on one machine without it, a
    temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='townhall-')}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, d):
    """CSV in parts, types inferred from the data."""
    path = scratch(spark, "csv")
    writers.write_csv(t(spark, d, "customer"), path, one_file=False)
    back = readers.read_csv(spark, path, infer=True)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", r("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT o_orderkey, o_orderdate::DATE AS ordered, o_orderpriority FROM orders")
def csv_typed_dates(spark, d):
    """Pinned types and a date pattern."""
    path = scratch(spark, "csv")
    writers.write_csv(t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("ordered"), "o_orderpriority"), path, one_file=False)
    return readers.read_csv(spark, path, "o_orderkey BIGINT, ordered DATE, o_orderpriority STRING", dates="dd/MM/yyyy")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_sorted_text(spark, d):
    """One sorted file; read as text throughout."""
    path = scratch(spark, "csv")
    writers.write_csv(t(spark, d, "nation"), path, ["n_name"])
    return readers.read_csv(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def tab_separated(spark, d):
    path = scratch(spark, "tsv")
    t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_csv(spark, path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT", sep="\t")


def _file(spark: SparkSession, df: DataFrame, line: str, head: str, order: str, path: str) -> None:
    """A text file of ``head`` and a line for each row of a small table."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.expr(line).alias("line")))), lambda x: x["line"])
    df.agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("value")).coalesce(1).write.text(path)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 12 THEN n_regionkey END AS n_regionkey FROM nation")
def csv_with_preamble(spark, d):
    """Headers on the second line; the parts differ in the order and number of their columns."""
    nation, path = t(spark, d, "nation"), scratch(spark, "preamble")
    _file(spark, nation.filter("n_nationkey < 12"), "concat_ws(',', n_name, n_regionkey, n_nationkey)", "made for a test\nn_name,n_regionkey,n_nationkey\n", "n_nationkey", f"{path}/a")
    _file(spark, nation.filter("n_nationkey >= 12"), "concat_ws(',', n_nationkey, n_name)", "made for a test\nn_nationkey,n_name\n", "n_nationkey", f"{path}/b")
    return readers.read_csv(spark, [f"{path}/a", f"{path}/b"], "n_nationkey INT, n_name STRING, n_regionkey INT", header=1)


@query("SELECT n_name AS name, n_regionkey AS region, n_nationkey::DOUBLE AS x FROM nation")
def geojson(spark, d):
    path = scratch(spark, "geojson")
    feature = F.struct(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", F.lit(1)).alias("coordinates")).alias("geometry"))
    t(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(path)
    read = readers.read_geojson(spark, path, "name string, region int")
    return read.select("name", "region", F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("x"))


@query("SELECT n_nationkey, n_regionkey::DOUBLE AS pop, NULL::DOUBLE AS households FROM nation")
def header_row_answers(spark, d):
    """An API's [[names], [values]] answers; a name that is not there is missing."""
    answer = F.to_json(F.array(F.array(F.lit("name"), F.lit("pop")), F.array("n_name", F.col("n_regionkey").cast("string"))))
    return t(spark, d, "nation").select("n_nationkey", *readers.header_row_json(answer, ["pop", "households"]))


@query("SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def observation_series(spark, d):
    """A series written as an API's observations, and read from them."""
    daily = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    raw = daily.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("day").cast("string").alias("date"), F.col("n").cast("string").alias("value"))).alias("observations"))).alias("raw"))
    return readers.observations(raw, "raw")


@query("""SELECT n_nationkey, n_name, (k // 10)::INT AS page, (k % 10)::INT AS place
FROM (SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)""")
def paged_answers(spark, d):
    """Landed pages of ten rows; the one after the short page is left over from an earlier pull."""
    path = scratch(spark, "pages")
    places = t(spark, d, "nation").withColumn("k", F.row_number().over(Window.orderBy("n_name")) - 1)
    for page, rows in enumerate([places.filter(f"k div 10 = {p}") for p in range(3)] + [places.filter("k < 10")]):
        answer = F.to_json(F.array_sort(F.collect_list(F.struct("k", "n_nationkey", "n_name"))))
        rows.agg(answer.alias("value")).coalesce(1).write.text(f"{path}/page-{page}")
    return readers.read_pages(spark, f"{path}/page-*", "n_nationkey int, n_name string", 10)


#: A workbook's parts around its one sheet, as the format asks for them.
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def _workbook(rows: list[list[str]]) -> bytes:
    cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    return _zip({"[Content_Types].xml": TYPES.encode(), "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{readers.SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>'.encode()})


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """Archives of the nations as a table by year: separated text in Latin-1, and a workbook."""
    rows = [[str(x) for x in row] for row in t(spark, d, "nation").orderBy("n_nationkey").limit(25).collect()]
    table = [["SURVEY", "", "", ""], ["area", "AREA_TITLE", "occ_code", "tot_emp"], *[[k, f"{name} é", f"11-{k}", reg] for k, name, reg in rows]]
    text = "\n".join(",".join(row) for row in table).encode("latin-1")
    made = [("oesm19st.zip", _zip({"a.csv": text, "readme.txt": b"x"})), ("oesm20st.zip", _zip({"b.xlsx": _workbook(table)})), ("oesm21st.zip", b"broken")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in made], "path string, content binary")


ARCHIVED = "SELECT y.year, n_name || ' é' AS area_name, '11-' || n_nationkey AS occ_code, n_regionkey::VARCHAR AS tot_emp FROM nation, (VALUES (2019), (2020)) y(year)"


@query(ARCHIVED)
def archived_panel(spark, d):
    """Tables out of archives: header found by its tokens, columns by their synonyms, year by name."""
    panel, _ = panels.wage_panel(_archives(spark, d), panels.Scope((F.lit(True),), "all"))
    return panel.select("year", "area_name", "occ_code", "tot_emp")


@query("SELECT path, n FROM (VALUES ('oesm19st.zip', 27::BIGINT), ('oesm20st.zip', 27), ('oesm21st.zip', 0)) v(path, n)")
def archive_provenance(spark, d):
    files = _archives(spark, d)
    return writers.provenance(files, readers.zip_rows(files).filter("error IS NULL")).select("path", F.col("n_rows").alias("n"))


@query("SELECT n_name, min(c_custkey) AS first_year, max(c_custkey) AS last_year, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS codes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def panel_dictionary(spark, d):
    both = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return writers.data_dictionary(both, "n_name", "c_mktsegment", "c_custkey").withColumn("codes", F.array_join("codes", ","))


@query("SELECT n_nationkey, n_name, n_regionkey, 25::BIGINT AS total FROM nation")
def nested_json(spark, d):
    path = scratch(spark, "json")
    writers.write_nested_json(t(spark, d, "nation"), path, "n_nationkey", total=F.count("*"))
    back = readers.read_json_array(spark, path, "total BIGINT, items ARRAY<STRUCT<n_nationkey: INT, n_name: STRING, n_regionkey: INT>>")
    return back.select("total", F.explode("items").alias("i")).select("i.*", "total")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS q FROM embeddings WHERE vec_id % 3 <> 0")
def vector_cache(spark, d):
    """Vectors written once, and what a later run still has to make."""
    vectors, path = t(spark, d, "embeddings"), scratch(spark, "vectors")
    writers.write_vectors(vectors.filter("vec_id % 3 = 0"), path, "vec_id", "embedding")
    rest = vectors.join(spark.read.parquet(path).select("vec_id"), "vec_id", "left_anti")
    return rest.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 5).alias("q"))


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 10) GROUP BY 1")
def appended_rows(spark, d):
    """A log that rows are appended to, and an aggregate that replaces the one before."""
    nation, path = t(spark, d, "nation"), scratch(spark, "log")
    for part in (nation, nation.filter("n_nationkey < 10")):
        writers.append_rows(part, f"{path}/log")
        writers.replace_one_row(spark.read.parquet(f"{path}/log").groupBy("n_regionkey").agg(F.count("*").alias("n")), f"{path}/tally")
    return spark.read.parquet(f"{path}/tally")


@query("SELECT 'orders' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'largest', max(o_totalprice) FROM orders")
def pinned_headlines(spark, d):
    return writers.headline({"orders": F.count("*"), "largest": F.max("o_totalprice")}, t(spark, d, "orders"))


@query("SELECT path, path <> 'b' AS valid FROM (VALUES ('a'), ('b'), ('c')) v(path)")
def slice_headers(spark, d):
    files = spark.createDataFrame([("a", 'YEAR,"qtr",area\n1,2,3'), ("b", "<html>no such slice</html>"), ("c", "area, qtr ,year,more\n")], "path string, value string")
    return readers.valid_slices(files, ["year", "qtr", "area"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def aligned_left(spark, d):
    names = t(spark, d, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return series.align_left(t(spark, d, "customer"), names, "c_nationkey", "n_name", "n_name").select("c_custkey", "n_name")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS segment, least(5000, greatest(0, c_acctbal)) AS bounded,
coalesce(c_acctbal > 0, false) AND coalesce(c_nationkey < 9, false) AS chosen FROM customer""")
def recoded(spark, d):
    df = reshape.recode(t(spark, d, "customer"), "c_mktsegment", {"BUILDING": "B"})
    return df.select("c_custkey", F.col("c_mktsegment").alias("segment"), reshape.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("bounded"), semantics.all_of([F.col("c_acctbal") > 0, F.col("c_nationkey") < 9]).alias("chosen"))


@query("SELECT 'nation' AS level, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def stacked_by_level(spark, d):
    frames = {"nation": t(spark, d, "nation").select(F.col("n_name").alias("name")), "region": t(spark, d, "region").select(F.col("r_name").alias("name"))}
    return reshape.stack_keyed(frames, "level").select("level", "name")


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def first_rich_customer(spark, d):
    return selection.first_match(t(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal") > 5000, [F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@query("""WITH y AS (SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1)
SELECT year, n, CASE WHEN year < 1980 THEN '1970s' WHEN year < 1990 THEN '1980s' WHEN year < 2000 THEN '1990s' WHEN year < 2015 THEN '2000-2014' ELSE '2015+' END AS era
FROM y ORDER BY n, year LIMIT 1""")
def trough_year(spark, d):
    yearly = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return people.trough(yearly, "year", "n").withColumn("era", people.plan_era(F.col("year")))


@query("""SELECT n_name, round(CASE WHEN n_regionkey = 0 THEN 0 ELSE (n_regionkey + 5.0) * n_nationkey END, 4) AS weekly, round(52 * CASE WHEN n_regionkey = 0 THEN 0 ELSE (n_regionkey + 5.0) * n_nationkey END - 1000, 4) AS vs_today,
round(CASE WHEN n_nationkey = 0 THEN NULL ELSE 1500.0 * 12 / (n_nationkey * 2080.0) END, 6) AS rent FROM nation""")
def rebuttal_table(spark, d):
    rows = t(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("double").alias("base"), F.col("n_nationkey").cast("double").alias("hours"))
    out = wages.rebuttal(rows, F.lit(5.0), F.lit(1000.0))
    return out.select("n_name", r("weekly", 4).alias("weekly"), r("vs_today", 4).alias("vs_today"), r(wages.rent_share(F.col("hours"), F.lit(1500.0), 2080.0)).alias("rent"))


@query("SELECT name, " + ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS r{k}" for k in range(5)) + """ FROM (
SELECT 'customers' AS name, n_regionkey AS k, count(*)::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2
UNION ALL SELECT 'nations', n_regionkey, count(DISTINCT n_nationkey)::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2) GROUP BY 1""")
def transposed_counts(spark, d):
    both = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = both.groupBy("n_regionkey").agg(F.count("*").cast("double").alias("customers"), F.count_distinct("n_nationkey").cast("double").alias("nations"))
    return reshape.transposed(wide, "n_regionkey", ["customers", "nations"], list(range(5))).toDF("name", *[f"r{k}" for k in range(5)])


@query("SELECT 'both' AS kind, 'key' AS name UNION ALL SELECT 'left', 'n_name' UNION ALL SELECT 'left', 'n_regionkey' UNION ALL SELECT 'right', 'r_name'")
def column_names(spark, d):
    sets = reshape.column_sets(t(spark, d, "nation").withColumnRenamed("n_nationkey", "key"), t(spark, d, "region").withColumnRenamed("r_regionkey", "key"))
    return spark.createDataFrame([(k, c) for k, names in sets.items() for c in names], "kind string, name string")


BOOTSTRAP = "WITH b(k, f) AS (VALUES (1, 0.36787944117144233::DOUBLE), (2, 0.7357588823428847), (3, 0.9196986029286058), (4, 0.9810118431238462), (5, 0.9963401531726563), (6, 0.9994058151824183), (7, 0.999916758850712), (8, 0.9999897508033253)), "


@query(BOOTSTRAP + """u AS (SELECT c_mktsegment, c_acctbal, draw, ('0x' || substr(md5('42/' || draw || '/' || c_custkey), 1, 8))::BIGINT / 4294967296.0 AS u FROM customer, range(1, 41) r(draw)),
w AS (SELECT c_mktsegment, c_acctbal, draw, (SELECT count(*) FROM b WHERE u >= f) AS w FROM u),
m AS (SELECT c_mktsegment, draw, sum(c_acctbal * w) / sum(w) AS m FROM w GROUP BY 1, 2),
e AS (SELECT c_mktsegment, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT c.c_mktsegment, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM customer c JOIN e ON c.c_mktsegment = e.c_mktsegment GROUP BY 1""")
def mean_with_interval(spark, d):
    out = aggregates.mean_interval(t(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", draws=40)
    return out.select("c_mktsegment", "n", r("mean", 4).alias("mean"), r("low", 4).alias("low"), r("high", 4).alias("high"))


@query("SELECT doc_id, doc_id % 2 = 0 AS hit FROM documents")
def cache_hits_and_misses(spark, d):
    chunks = t(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("text", F.lit(""))).alias("text"))
    known = chunks.filter("doc_id % 2 = 0").select(documents.content_hash(F.col("text")).alias("hash"))
    hits, misses = documents.cache_split(chunks, known)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("SELECT x.n_name, y.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation) x JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS k FROM region) y ON x.k = y.k")
def zipped_by_position(spark, d):
    return reshape.by_position(t(spark, d, "nation"), t(spark, d, "region"), "n_name", "r_name").select("n_name", "r_name")


@query("""SELECT event_id, upper(event_type) AS kind, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS number, regexp_replace(event_type, '[aeiou]', '_', 'g') AS masked, length(trim(event_type)) AS size
FROM events WHERE regexp_matches(event_type, '(?i)^[a-p]') AND value IS NOT NULL""")
def text_functions(spark, d):
    kept = t(spark, d, "events").filter(F.col("event_type").rlike("(?i)^[a-p]")).dropna(subset=["value"])
    return kept.select("event_id", F.upper("event_type").alias("kind"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("number"), F.regexp_replace("event_type", "[aeiou]", "_").alias("masked"), F.length(F.trim("event_type")).cast("long").alias("size"))


def _streamed(spark: SparkSession, d: str, make, mode: str) -> DataFrame:
    """The result of a stream over landed events, run until all are read."""
    landed, name = scratch(spark, "events"), f"t{uuid.uuid4().hex}"
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(landed)
    stream = make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landed))
    started = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.table(name)


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    out = _streamed(spark, d, lambda s: tally.windowed_counts(s, "ts", "1 day", "1 day", "event_type"), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (event_type = 'click')::BIGINT AS \"usedRevenue\", count(*) FILTER (value > 50)::BIGINT AS \"usedVote\", count(*) FILTER (user_id % 2 = 0)::BIGINT AS \"usedReserves\" FROM events")
def streamed_tally(spark, d):
    flags = lambda s: s.withColumns({"used_revenue": F.col("event_type") == "click", "used_vote": F.col("value") > 50, "used_reserves": F.col("user_id") % 2 == 0})
    return _streamed(spark, d, lambda s: tally.running_tally(flags(s)), "complete")


@query("SELECT count(DISTINCT user_id)::BIGINT AS n FROM events")
def streamed_first_submissions(spark, d):
    """One row for each user, however often they come within the watermark."""
    return _streamed(spark, d, lambda s: tally.first_submissions(s, "user_id", "ts", "10000 days").select("user_id"), "append").agg(F.count("*").alias("n"))
