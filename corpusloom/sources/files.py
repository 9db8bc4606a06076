"""Readers of files: text documents, their CSV tables, the older text form, configuration, checkpoints, PDF blocks."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import shared_file

#: Fixed header of the CSV table of a document.
CSV_HEADER = "DocEltType;DocEltCmd;NestingLevel;Text;Lang;Chars;Words;AvgWordsLength;LetterChars;NumberChars;OtherChars;HashCode;IsUnique"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, lang, text) of all ``*.<lang>.text.md`` files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.text.md").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.regexp_extract(path, r"\.(..)\.text\.md$", 1).alias("lang"), F.col("value").alias("text"))


def read_properties(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, uri, timestamp) from the first lines of all ``*.dataframe.csv`` files; lines are told by their prefix alone."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.dataframe.csv").text(folder)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").startswith("Document;"))
    own = lambda name: F.max(F.when(F.col("value").startswith(f"Document;{name};"), T.csv_decoded(F.col("value"))))
    return lines.groupBy("path").agg(own("Title").alias("title"), own("Uri").alias("uri"), own("Timestamp").alias("timestamp"))


def read_elements_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all ``*.dataframe.csv`` files, with their path."""
    ddl = "DocEltType string, DocEltCmd string, NestingLevel int, Text string, Lang string, Chars int, Words int, AvgWordsLength int, LetterChars int, NumberChars int, OtherChars int, HashCode bigint, IsUnique boolean"
    reader = spark.read.schema(ddl).option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.dataframe.csv").csv(folder).withColumn("path", F.col("_metadata.file_path"))


#: Fixed marks of the older text form.
_LEGACY_PROPERTY = r"(?s)^## NLPTextDocument (\w+) ?(.*)$"
_LEGACY_ELEMENT = r"(?s)^## (\d+) (\w+) (Start|End|Items) ?(.*)$"


def parse_legacy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, elt_type, cmd, nesting_level, text) of documents in the older line form.

    Lines of items are cut at ``||`` after ``>>`` and give a row each; other lines are
    text blocks at the level of the group open around them; empty lines are skipped.  A
    line that begins with ``##`` but is neither property nor element raises an error.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    prop, elem = F.regexp_extract("line", _LEGACY_PROPERTY, 1), F.regexp_extract("line", _LEGACY_ELEMENT, 2)
    bad = F.col("line").startswith("## ") & (prop == "") & (elem == "")
    cmd = F.regexp_extract("line", _LEGACY_ELEMENT, 3)
    level = F.regexp_extract("line", _LEGACY_ELEMENT, 1)
    rest = F.regexp_extract("line", _LEGACY_ELEMENT, 4)
    steps = F.when(cmd == "Start", 1).when(cmd == "End", -1).otherwise(0)
    depth = F.sum(steps).over(Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    named = lines.select(
        id_col, "line_no", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("line")))).otherwise(F.lit(None)).alias("problem"),
        F.when(prop != "", "Document").when(elem != "", elem).otherwise("TextBlock").alias("elt_type"),
        F.when(prop != "", prop).when(cmd != "", cmd).otherwise("Text").alias("cmd"),
        F.when(level != "", level.cast("int")).when(prop != "", F.lit(0)).otherwise(depth.cast("int") + 1).alias("nesting_level"),
        F.when(prop != "", F.regexp_extract("line", _LEGACY_PROPERTY, 2)).when(elem != "", rest).otherwise(F.col("line")).alias("text"),
    )
    items = F.when(F.col("cmd") == "Items", F.split(F.regexp_extract("text", r">>\s?(.*)$", 1), r"\s*\|\|\s*")).otherwise(F.array(F.lit(None).cast("string")))
    title = F.when(F.col("cmd") == "Items", F.trim(F.regexp_extract("text", r"^(.*?)\s*>>", 1))).otherwise(F.col("text"))
    spread = named.withColumn("title", title).select("*", F.posexplode(items).alias("item_no", "item"))
    item = F.col("item").isNotNull()
    out = spread.select(
        id_col, "line_no", "item_no", "problem", F.when(item, "ListItem").otherwise(F.col("elt_type")).alias("elt_type"), F.when(item, "Text").otherwise(F.col("cmd")).alias("cmd"),
        F.when(item, F.col("nesting_level") + 1).otherwise(F.col("nesting_level")).alias("nesting_level"), F.when(item, F.col("item")).otherwise(F.nullif("title", F.lit(""))).alias("text"),
    )
    pos = F.row_number().over(Window.partitionBy(id_col).orderBy("line_no", "item_no")) - 1
    return out.where("problem IS NULL").select(id_col, pos.alias("pos"), "elt_type", "cmd", "nesting_level", "text")


@dataclass(frozen=True)
class CrawlParams:
    """Parameters of a crawl, with the defaults of the command line."""

    scope: str = "domain"
    rootUrl: str = ""
    storageDir: str = "."
    maxDuration: int = 0
    maxPageCount: int = 0
    maxErrorsCount: int = 10
    minUniqueText: int = 5
    maxSizeOnDisk: int = 0
    minCrawlDelay: int = 100
    excludeUrls: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, lines: list[str], base: CrawlParams | None = None) -> CrawlParams:
        """Read ``key=value`` lines: ``#`` begins a comment line, names are read without regard to case and blanks, later lines win,
        a value ends at a second ``=``, a new scope clears the exclusions.  A line without ``=`` or without a value, an unknown name or
        scope, and a number that is none raise an error."""
        out = base or cls()
        names = {f.name.lower(): (f.name, f.type) for f in fields(cls)}
        for line in lines:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, *rest = (part.strip() for part in line.split("="))
            if not rest or not rest[0]:
                raise ValueError(f"no value: {line}")
            name, kind = names.get(key.lower(), ("", ""))
            value = rest[0]
            if name == "excludeUrls":
                out = replace(out, excludeUrls=(*out.excludeUrls, value))
            elif name == "scope":
                if value.lower() not in ("domain", "subdomain", "path"):
                    raise ValueError(f"unknown scope: {value}")
                out = replace(out, scope=value.lower(), excludeUrls=())
            elif name:
                try:
                    out = replace(out, **{name: int(value) if kind == "int" else value})
                except ValueError:
                    raise ValueError(f"no number: {line}") from None
            else:
                raise ValueError(f"unknown parameter: {key}")
        return out

    def lines(self) -> list[str]:
        plain = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name != "excludeUrls" and getattr(self, f.name) != ""]
        return plain + [f"excludeUrls={x}" for x in self.excludeUrls]

    def append_to(self, path: str) -> None:
        """Add the parameters to a configuration file under the time they were set, keeping what earlier runs wrote."""
        with open(path, "a", encoding="utf-8") as out:
            out.write("\n".join([f"# {datetime.datetime.now():%Y-%m-%d %H:%M:%S}", *self.lines(), ""]))


def effective_config(websites: DataFrame) -> DataFrame:
    """One row a root: of repeated rows the one of the latest line holds."""
    return websites.groupBy("root_id").agg(F.max_by(F.struct(*websites.columns), "config_line").alias("x")).select("x.*")


def read_checkpoint(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Known addresses, waiting pages and unique blocks of a stopped crawl, from its JSON files."""
    ids = spark.read.schema("UrlRepository map<string, tinyint>").option("multiLine", True).json(f"{folder}/crawledUrls.json")
    waiting = spark.read.schema("UrlQueue array<struct<Uri: string, ParentUri: string, IsRetry: boolean, RetryCount: int, IsRoot: boolean, IsInternal: boolean, CrawlDepth: int>>")
    parsed = spark.read.text(f"{folder}/uniqueTextBlocks.json", wholetext=True).select(F.from_json("value", "map<string, int>").alias("m"))
    return {
        "known": ids.select(F.explode("UrlRepository").alias("url_id", "one")).select(F.col("url_id").cast("bigint").alias("url_id")),
        "frontier": waiting.option("multiLine", True).json(f"{folder}/pagesToCrawl.json").select(F.explode("UrlQueue").alias("x")).select("x.*"),
        "unique_blocks": parsed.select(F.explode("m").alias("hash", "words")).select(F.col("hash").cast("bigint").alias("hash"), "words"),
    }


def write_checkpoint(folder: str, known: DataFrame, frontier: DataFrame, unique_blocks: DataFrame, stats: dict | None = None) -> None:
    """The state of a stopped crawl as JSON files that :func:`read_checkpoint` reads: known address ids, waiting pages, unique blocks.

    Each file is one JSON value, as the format has it, put together from one row a task by the driver's writer of
    one partition; for crawls beyond that keep the tables of :class:`corpusloom.plans.crawl.Rounds` themselves.
    """
    pair = lambda k, v: F.concat(F.lit('"'), F.col(k).cast("string"), F.lit('":'), v)
    page = F.to_json(F.struct(*(F.col(c) for c in frontier.columns)))
    for name, rows, head, tail in (
        ("crawledUrls.json", known.select(pair("url_id", F.lit("0")).alias("value")), '{"UrlRepository":{', "}}"),
        ("pagesToCrawl.json", frontier.select(page.alias("value")), '{"UrlQueue":[', "]}"),
        ("uniqueTextBlocks.json", unique_blocks.select(pair("hash", F.col("words").cast("string")).alias("value")), "{", "}"),
    ):
        with shared_file(f"{folder}/{name}") as out:
            out.write(head.encode())
            for i, row in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
                out.write((("," if i else "") + row.value).encode())
            out.write(tail.encode())
    if stats is not None:
        with shared_file(f"{folder}/extractionStats.json") as out:
            out.write(json.dumps(stats).encode())


def pdf_elements(blocks: DataFrame, doc: str = "doc_id", order: str = "ord", strict_parity: bool = True) -> DataFrame:
    """(doc, ord, elt_type, nesting_level, text) from the blocks of PDF documents, in reading order.

    ``blocks`` has text, n_lines, line_height and decoration.  Running heads and page
    numbers go if the document has more than one page, and so do blocks of one character
    but the last.  A short block of at most two lines, set larger than the next one by a
    fifth and above 8 points, is a title; with ``strict_parity`` sections only nest deeper.
    """
    per_doc, run = Window.partitionBy(doc), Window.partitionBy(doc).orderBy(order)
    pages = F.max("page").over(per_doc)
    kept = blocks.withColumn("_pages", pages).where((F.col("_pages") <= 1) | ~F.coalesce("decoration", F.lit(False)))
    last = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(order))) == 1
    kept = kept.withColumn("_last", last).where((F.length(T.trimmed(F.col("text"))) > 1) | F.col("_last"))
    after = F.lead("line_height").over(run)
    title = F.coalesce((F.col("n_lines") <= 2) & (F.col("line_height") > after * 1.2) & (F.col("line_height") > 8), F.lit(False))
    out = kept.withColumn("is_title", title)
    nested = F.sum(F.col("is_title").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    level = nested + F.when(F.col("is_title"), 0).otherwise(1) if strict_parity else F.when(F.col("is_title"), 1).otherwise(F.least(nested, F.lit(1)) + 1)
    return out.select(doc, order, F.when(F.col("is_title"), "Section").otherwise("TextBlock").alias("elt_type"), level.cast("int").alias("nesting_level"), "text")
