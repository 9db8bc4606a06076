"""The dataset job: selection of sites, splits, summaries, card, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

MIN_FILES = 50
SPLITS = ("train", "valid", "test")


def language_counts(files: DataFrame, site: str, lang: str) -> DataFrame:
    return files.groupBy(site, lang).agg(F.count(F.lit(1)).alias("files"))


def sites_with(files: DataFrame, site: str, lang: str, language: str, least: int = MIN_FILES) -> DataFrame:
    """Sites that have enough files of a language."""
    return files.where(F.col(lang) == language).groupBy(site).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= least).select(site)


def with_split(docs: DataFrame, site: str, order: Column, percent_valid: int = 10, percent_test: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Documents with ``split``: per site the first part is for training, the next for validation, the rest for test.

    The shuffle is by a hash, so that it is the same each time.  Positions are counted in
    two steps: documents are spread over hash classes of each site, whose sizes are
    added up, and ranked within a class, so that a site with a third of all documents is
    not sorted in one task.
    """
    classes = 256
    # classes keep the order of the hash: its first two hexadecimal digits
    placed = docs.withColumn("_order", order).withColumn("_class", F.substring("_order", 1, 2))
    sizes = placed.groupBy(site, "_class").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(site).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        site, "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(site)).alias("_total")
    )  # at most 256 rows a site
    assert classes == 16**2
    within = F.row_number().over(Window.partitionBy(site, "_class").orderBy("_order", id_col))
    ranked = placed.withColumn("_within", within).join(offsets, [site, "_class"])
    index = F.col("_offset") + F.col("_within") - 1
    valid_from = F.floor(F.col("_total") * (100 - percent_valid - percent_test) / 100)
    test_from = F.floor(F.col("_total") * (100 - percent_test) / 100)
    split = F.when(index < valid_from, SPLITS[0]).when(index < test_from, SPLITS[1]).otherwise(SPLITS[2])
    return ranked.withColumn("split", split).drop("_order", "_class", "_within", "_offset", "_total")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("examples"))


def website_summary(docs: DataFrame, site: str, pdf: Column, words: Column) -> DataFrame:
    """(site, html_pages, pdf_documents, words)."""
    return docs.groupBy(site).agg(F.count_if(~pdf).alias("html_pages"), F.count_if(pdf).alias("pdf_documents"), F.sum(words).alias("words"))


def records(docs: DataFrame, uri: str, timestamp: Column, lang: str, title: str, text: str, website: str) -> DataFrame:
    """Dataset records: the thirteen columns, with statistics of the text as it is written."""
    from corpusloom.functions.url import is_pdf

    names = {"Words": "words", "AvgWordsLength": "avg_word_length", "Chars": "chars", "LetterChars": "letter_chars", "NumberChars": "number_chars", "OtherChars": "other_chars"}
    heads = docs.select(
        F.col(uri).alias("Uri"), F.date_format(timestamp, "MM/dd/yyyy HH:mm:ss").alias("Timestamp"), F.col(lang).alias("Lang"), F.col(title).alias("Title"),
        F.col(text).alias("Text"), F.col(website).alias("Website"), is_pdf(F.col(uri)).alias("PDF"),
    )
    made = T.with_statistics(heads, "Text")
    return made.select("Uri", "Timestamp", "Lang", "Title", "Text", *(F.col(own).alias(name) for name, own in names.items()), "Website", "PDF")


def write_dataset(rows: DataFrame, folder: str, records_per_file: int = 1_000_000) -> None:
    """Parquet files by split and website, Snappy.

    Rows are spread by split and website, and those of a site over as many tasks as it has files of
    ``records_per_file``, by a hash; the sizes are one row a split and site.
    """
    sizes = rows.groupBy("split", "Website").agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.select(F.col("split").alias("_split"), F.col("Website").alias("_site"), F.ceil(F.col("_n") / records_per_file).alias("_parts"))
    placed = rows.join(parts, (F.col("split") == F.col("_split")) & F.col("Website").eqNullSafe(F.col("_site")))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("Uri"), F.col("_parts"))).drop("_split", "_site", "_parts")
    salted = placed.repartition("split", "Website", "_part").drop("_part")
    salted.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", records_per_file).partitionBy("split", "Website").parquet(folder)


def dataset_card(domain: str, language: str, year_month: str, examples: dict[str, int], download_bytes: int, sites: list[tuple]) -> str:
    """Text of a dataset card; ``sites`` has (website, html pages, PDF documents, words) of each site, from one small table."""
    total = sum(examples.values())
    limits = [(9, "1B<n<10B"), (8, "100M<n<1B"), (7, "10M<n<100M"), (6, "1M<n<10M"), (5, "100K<n<1M"), (4, "10K<n<100K"), (3, "1K<n<10K")]
    size = next((name for power, name in limits if total > 10**power), "n<1K")
    fields = "Uri Timestamp Lang Title Text".split(), "Words AvgWordsLength Chars LetterChars NumberChars OtherChars".split()
    features = [(n, "string") for n in fields[0]] + [(n, "int32") for n in fields[1]] + [("Website", "string"), ("PDF", "bool")]
    head = ["---", f"pretty_name: {domain}-{language}-{year_month}", "language:", f"- {language}", "size_categories:", f"- {size}", "dataset_info:", "  features:"]
    head += [line for name, kind in features for line in (f"  - name: {name}", f"    dtype: {kind}")]
    head += ["  splits:"] + [line for name in SPLITS for line in (f"  - name: {name}", f"    num_examples: {examples.get(name, 0)}")]
    head += [f"  download_size: {download_bytes}", "---"]
    table = ["| Website | HTML pages | PDF documents | Words |", "| :--- | ---: | ---: | ---: |"]
    table += [f"| {s[0]} | {s[1]} | {s[2]} | {s[3]} |" for s in sorted(sites)]
    return "\n".join([*head, "", f"# {domain}, {language}, {year_month}", "", *table, ""])
