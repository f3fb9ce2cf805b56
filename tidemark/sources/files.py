"""Sources of the pipeline: price lists as workbooks, price tables as CSV, news and predictions as JSON lines, pages as HTML.

All are distributed: files are listed by Spark and parsed where they are read. Defined results: missing or unreadable files
and malformed lines give no rows; a missing directory gives an empty frame.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = [f"c{i}" for i in range(7)]
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day, file_name): every calendar day and the name of its price list."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    return days.select("day", F.concat(F.date_format("day", "dd-MMMM-yyyy"), F.lit(".xls")).alias("file_name"))


def missing_files(spine: DataFrame, present: DataFrame) -> DataFrame:
    """The days of the spine whose file is not among ``present`` (file_name)."""
    return spine.join(present.select("file_name"), "file_name", "left_anti").select("day", "file_name")


def read_workbook(raw: bytes) -> list[list[str | None]]:
    """Rows of the sheet ``Sheet1``, else of the first, of an Office Open XML workbook; [] if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
            sheets = {s.get("name"): s.get(f"{{{_NS['r']}}}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")}
            wanted = sheets["Sheet1"] if "Sheet1" in sheets else next(iter(sheets.values()))
            parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
            part = parts.get(wanted) or f"worksheets/sheet{list(sheets.values()).index(wanted) + 1}.xml"
            rows = []
            for row in ElementTree.fromstring(z.read(part.removeprefix("/") if part.startswith("/") else f"xl/{part}")).iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    column = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters.group()))) - 1 if letters else len(cells)
                    cells += [None] * (column - len(cells))
                    value, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else value.text if value is not None else None
                    cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                rows.append(cells)
            return rows
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, StopIteration):
        return []


def workbooks(spark: SparkSession, folder: str, width: int = len(CELLS)) -> DataFrame:
    """(file_stem, row_no, c0, c1, ...): the first ``width`` cells of each row of every workbook of a folder; the first row
    of a sheet is its header. A price list has no more than seven that count."""
    cells = [f"c{i}" for i in range(width)]
    schema = "file_stem string, row_no int, " + ", ".join(f"{c} string" for c in cells)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(folder).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], schema)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for path, content in zip(part["path"], part["content"], strict=True):
                stem = re.sub(r"\.xlsx?m?$", "", path.rpartition("/")[2])
                rows = [(stem, i, *(r + [None] * width)[:width]) for i, r in enumerate(read_workbook(content)[1:])]
                yield pd.DataFrame(rows, columns=["file_stem", "row_no", *cells])

    return files.mapInPandas(parse, schema)


def security_rows(cells: DataFrame, share_word: str = "Ord", isin_country: str = "KE") -> DataFrame:
    """(security, date, shares, market_cap, vwap, high, low): the rows that name an ordinary share. Rows with an ISIN in
    their second cell hold the values one cell further on."""
    isin = F.coalesce((F.length(F.trim("c1")) == 12) & F.trim("c1").startswith(isin_country), F.lit(False))
    names = ("shares", "market_cap", "vwap", "high", "low")
    values = [F.when(isin, F.col(f"c{i + 2}")).otherwise(F.col(f"c{i + 1}")).alias(n) for i, n in enumerate(names)]
    return cells.where(F.col("c0").contains(share_word)).select(F.trim("c0").alias("security"), F.col("file_stem").alias("date"), *values)


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """A price table, all columns text, with the order of its lines in ``line``; empty if there is none."""
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], "`Stock Code` string, Date string, `Day's Final Price` string, line struct<file:string,at:bigint>")
    return rows.withColumn("line", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value variant): every line that is JSON; malformed lines are dropped."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, value string").select("path", F.try_parse_json("value").alias("value"))
    return lines.select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("value")).where("value is not null")


def having_key(lines: DataFrame, key: str) -> DataFrame:
    """The lines that are an object with the key, be its value null."""
    return lines.where(F.coalesce(F.array_contains(F.json_object_keys(F.to_json("value")), key), F.lit(False)))


def latest_file(spark: SparkSession, folder: str, pattern: str = "news_*.jsonl") -> str | None:
    """The file last modified, ties by name; None if there is none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    except AnalysisException:
        return None
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0] if row else None


def unwrap_predictions(lines: DataFrame) -> DataFrame:
    """(prediction variant): of wrapped rows their prediction, of others the row; rows whose prediction is null are dropped."""
    wrapped = F.array_contains(F.json_object_keys(F.to_json("value")), "prediction")
    chosen = F.when(wrapped, F.try_variant_get("value", "$.prediction", "variant")).otherwise(F.col("value"))
    return lines.select(chosen.alias("prediction")).where(F.col("prediction").isNotNull() & ~F.is_variant_null("prediction"))


class _Anchors(HTMLParser):
    def __init__(self, section: str):
        super().__init__(convert_charrefs=True)
        self.section, self.out, self.open, self.time = section, [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and self.section in (a.get("href") or ""):
            self.open = [a["href"], "", None]
        elif tag == "time" and self.out:
            self.time = self.out[-1]
            self.time[2] = self.time[2] or a.get("datetime")

    def handle_data(self, data):
        if self.open is not None:
            self.open[1] += data
        elif self.time is not None and self.time[2] is None:
            self.time[2] = data.strip() or None

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.out.append(self.open)
            self.open = None
        elif tag == "time":
            self.time = None


def page_links(pages: DataFrame, base_url: str, section: str = "") -> DataFrame:
    """(page_id, url, title, published): the anchors of each page whose address holds ``section``, one a url, with the
    date of the time element after them."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for page, html in zip(part["page_id"], part["html"], strict=True):
                parser, seen = _Anchors(section), set()
                parser.feed(html or "")
                for href, title, when in parser.out:
                    url = urljoin(base_url, href)
                    if url not in seen:
                        seen.add(url)
                        rows.append((page, url, title.strip(), when))
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "published"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, url string, title string, published string")


def synthetic_predictions(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Labelled rows for demonstrations: classes 40/35/25, right more often at higher confidence."""
    u = lambda k: F.rand(seed + k)
    rows = spark.range(n).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("c"), u(4).alias("d"))
    label = F.when(F.col("a") < 0.4, "UP").when(F.col("a") < 0.75, "DOWN").otherwise("NEUTRAL")
    confidence = F.round(0.3 + 0.65 * F.col("b"), 2)
    right = F.col("c") < 0.35 + 0.4 * confidence
    wrong = F.when(label == "UP", "DOWN").otherwise("UP")
    predicted = F.when(right, label).otherwise(wrong)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("direct", "competitor", "sector_spillover", "supplier_chain", "regulatory")]), (F.col("d") * 5).cast("int") + 1)
    return rows.select("id", label.alias("price_label"), predicted.alias("predicted_direction"), confidence.alias("predicted_confidence"), kind.alias("impact_type"), right.alias("correct"))
