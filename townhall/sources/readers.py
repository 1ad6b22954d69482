"""Files whose layout needs more than an option of Spark's readers."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: str | StructType | None = None, header: int = 0, sep: str = ",", infer: bool = False, dates: str | None = None
) -> DataFrame:
    """CSV parts with their header on line ``header`` of each file.

    Without a schema all columns are text, or of the types that ``infer`` finds in the data; ``dates``
    is the pattern of dates. Lines before the header are dropped by their number within the file, and
    each file's columns go by its own header: files may differ in order, a column that one lacks is
    missing there. Where there is a preamble a file is one text value, and quoted line ends break rows.
    """
    parts = [paths] if isinstance(paths, str) else paths
    options = {"sep": sep} | ({"dateFormat": dates} if dates else {})
    if header == 0:
        reader = spark.read.options(header=True, inferSchema=infer and schema is None, **options)
        return (reader.schema(schema) if schema is not None else reader).csv(parts)
    whole = spark.read.text(parts, wholetext=True).select(F.split("value", "\r?\n").alias("_lines"))
    headed = whole.withColumn("_head", F.try_element_at("_lines", F.lit(header + 1))).filter("_head IS NOT NULL")
    heads = sorted(r[0] for r in headed.select("_head").distinct().collect())  # the layouts there are
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = {f.name: f.dataType.simpleString() for f in kinds} if kinds is not None else None
    read = []
    for head in heads:
        names = next(csv.reader([head], delimiter=sep))
        shape = ", ".join(f"`{n}` {(kinds or {}).get(n, 'string')}" for n in names)
        lines = headed.filter(F.col("_head") == head).select(F.posexplode("_lines").alias("_i", "_line")).filter((F.col("_i") > header) & (F.trim("_line") != ""))
        read.append(lines.select(F.from_csv("_line", F.lit(shape), options).alias("_r")).select("_r.*"))
    if not read:
        return spark.createDataFrame([], kinds and ", ".join(f"`{n}` {k}" for n, k in kinds.items()) or "value string")
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), read)
    return out if kinds is None else out.select(*[F.col(f"`{n}`") if n in out.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file that is one JSON array of objects, such as a configuration."""
    return spark.read.schema(schema).json(path, multiLine=True)


def valid_slices(files: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """path, valid of whole text files (path, value): whether the first line names all ``columns``."""
    names = F.transform(F.split(F.regexp_extract("value", "^\\ufeff?([^\r\n]*)", 1), f"[{sep}]"), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    wanted = F.array(*[F.lit(c.lower()) for c in columns])
    return files.select("path", (F.size(F.array_except(wanted, names)) == 0).alias("valid"))


def read_text_catalogue(spark: SparkSession, folder: str, catalogue: DataFrame, name: str = "file") -> DataFrame:
    """Catalogue rows joined with the whole texts of the files they name; missing files drop out."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias(name), F.col("value").alias("text"))
    return catalogue.join(texts, name)


def year_in_name(name: Column, pattern: str = r"(?i)oes[mn]?(\d{2})(ma|st|nat)", pivot: int = 97) -> Column:
    """The year that two digits in a file name stand for; missing where the pattern is."""
    digits = F.regexp_extract(name, pattern, 1)
    yy = F.when(digits != "", digits.cast("int"))
    return F.when(yy >= pivot, 1900 + yy).otherwise(2000 + yy)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features' properties as columns; the geometry stays JSON text."""
    raw = spark.read.text(path, wholetext=True)
    shape = f"features array<struct<properties: struct<{properties}>, geometry: string>>"
    return raw.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def header_row_json(raw: Column, names: list[str]) -> list[Column]:
    """Columns of an API's [[names], [values]] answer, by position in ``names``."""
    table = F.from_json(raw, "array<array<string>>")
    head = F.try_element_at(table, F.lit(1))
    row = F.try_element_at(table, F.lit(2))
    return [F.try_element_at(row, F.nullif(F.array_position(head, n).cast("int"), F.lit(0))).try_cast("double").alias(n) for n in names]


def observations(raw: DataFrame, column: str) -> DataFrame:
    """date, value rows of an {"observations": [{date, value}]} answer; '.' is missing."""
    shape = "struct<observations: array<struct<date: string, value: string>>>"
    rows = raw.select(F.explode(F.from_json(column, shape)["observations"]).alias("o"))
    return rows.select(F.to_date("o.date").alias("date"), F.col("o.value").try_cast("double").alias("value"))


def read_pages(spark: SparkSession, path: str, item: str, limit: int, pattern: str = r"page-(\d+)") -> DataFrame:
    """Rows (``item``: their schema) of landed answers of a paged API, with ``page`` and ``place``.

    Each file is an array of up to ``limit`` rows, its page's number is found in its path (files without
    one, and files that hold no array, are not read). The pull ends
    with the first page that is not full: pages beyond it are left over from a longer one.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int").alias("page"), F.from_json("value", f"array<struct<{item}>>").alias("rows")).filter("page IS NOT NULL")
    last = raw.filter(F.size("rows") < limit).agg(F.min("page").alias("last"))
    kept = raw.join(F.broadcast(last), F.coalesce(F.col("page") <= F.col("last"), F.lit(True)))  # one row
    return kept.select("page", F.posexplode("rows").alias("place", "row")).select("row.*", "page", "place")


def separator_of(text: str) -> str | None:
    """Tab, else comma, whichever gives more than three columns."""
    lines = [line for line in text.splitlines()[:200] if line.strip()]
    for sep in ("\t", ","):
        if any(len(row) > 3 for row in csv.reader(lines, delimiter=sep)):
            return sep
    return None


#: Members of archives that are no tables, and the name space of workbook sheets.
NO_TABLE = r"(^~\$)|(\baMSA)|(\bBOS)|(field_desc)|(file_desc)|(readme)|(layout)|(glossary)"


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's first sheet, row by row, as text; gaps are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        for row in ElementTree.fromstring(book.read(first)).iter(f"{SHEET}row"):
            cells: list[str] = []
            for cell in row.iter(f"{SHEET}c"):
                letters = re.sub("[^A-Z]", "", cell.get("r", ""))
                at = reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0) - 1 if letters else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value = cell.find(f"{SHEET}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield cells


def zip_rows(files: DataFrame, skip: str = NO_TABLE, keep: str = r"\.(csv|txt|xlsx)$", encoding: str = "latin-1") -> DataFrame:
    """(path, member, row, cells, error) of the tables inside archives (``binaryFile`` rows).

    Workbooks give their first sheet, as members or (with no member) as files of their own. A bad
    archive or member gives one row that carries its error; the others still come.
    """
    no, yes = re.compile(skip, re.I), re.compile(keep, re.I)

    def separated(raw: bytes) -> Iterator[list[str]]:
        text = raw.decode(encoding, "replace")
        sep = separator_of(text)
        if sep is None:
            raise ValueError("no separator gives more than three columns")
        yield from csv.reader(io.StringIO(text), delimiter=sep)

    def table(path: str, name: str | None, rows: Callable[[], Iterator[list[str]]]) -> Iterator[tuple]:
        try:
            for i, cells in enumerate(rows()):
                yield path, name, i, [c.strip() for c in cells], None
        except Exception as e:  # noqa: BLE001  whatever a member holds, the others count
            yield path, name, None, None, str(e)

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
            names = sorted(archive.namelist())
        except (zipfile.BadZipFile, ValueError) as e:
            yield path, None, None, None, str(e)
            return
        if "[Content_Types].xml" in names:
            yield from table(path, None, lambda: sheet_rows(content))
            return
        for name in names:
            if no.search(name.rsplit("/", 1)[-1]) or not yes.search(name):
                continue
            if name.lower().endswith(".xlsx"):
                yield from table(path, name, lambda name=name: sheet_rows(archive.read(name)))
            else:
                yield from table(path, name, lambda name=name: separated(archive.read(name)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                held: list[tuple] = []
                for r in members(path, content):
                    held.append(r)
                    if len(held) == 5000:
                        yield _frame(held)
                        held = []
                if held:
                    yield _frame(held)

    return files.select("path", "content").mapInPandas(run, "path string, member string, row int, cells array<string>, error string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "member", "row", "cells", "error"]).astype({"row": "Int32"})


def with_header(rows: DataFrame, tokens: list[str], scan: int = 80) -> DataFrame:
    """path, member, row, fields (a map by lower-case header): rows below each table's header.

    The header is the first of ``scan`` rows that holds one of ``tokens``.
    """
    keys = ["path", "member"]
    lower = F.transform("cells", lambda c: F.lower(F.trim(c)))
    named = rows.filter((F.col("row") < scan) & F.arrays_overlap(lower, F.array(*[F.lit(t) for t in tokens])))
    head = named.groupBy(*keys).agg(F.min("row").alias("_at"), F.min_by(lower, "row").alias("_head"))
    below = rows.join(head, keys).filter(F.col("row") > F.col("_at"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("_head"), F.size("cells"))))
    first = F.filter(places, lambda i: (F.array_position("_head", F.element_at(F.col("_head"), i)) == i) & (F.element_at(F.col("_head"), i) != ""))
    pairs = F.transform(first, lambda i: F.struct(F.element_at(F.col("_head"), i), F.element_at(F.col("cells"), i)))
    return below.select(*keys, "row", F.map_from_entries(pairs).alias("fields"))
