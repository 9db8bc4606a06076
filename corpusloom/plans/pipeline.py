"""The two jobs end to end: extract the documents of sites, and make a dataset of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import blocks as B
from corpusloom.operators import dataset as D
from corpusloom.sources import files, html, render
from corpusloom.storage import checkpointed


#: Bound of the table of sites in a dataset card.
MAX_SITES = 100_000


@dataclass
class Extraction:
    """Tables of an extracted site: element rows with statistics and uniqueness, and one row a document."""

    elements: DataFrame
    documents: DataFrame


def extract(pages: DataFrame, scope: str = "domain", language: DataFrame | None = None) -> Extraction:
    """Documents of ``pages`` (page_id, url, html, ts): elements, statistics, first-wins claim of texts per site, totals.

    ``language`` gives (page_id, lang, score) from any classifier; without it a text's
    language is unknown, ``?``.  Pages of a site claim texts in the order of their ids.
    HTML is parsed once: its rows are written before three aggregates read them.
    """
    rows = html.html_elements(pages).where("error IS NULL").join(
        pages.select("page_id", "url", U.site_directory(F.col("url"), scope).alias("site"), F.col("ts")), "page_id"
    )
    rows = checkpointed(rows)
    units = rows.where("text IS NOT NULL AND (elt_type = 'TextBlock' OR cmd = 'Start' AND elt_type IN ('Section', 'Table'))")
    claimed = B.claim_unique(units.select("site", "page_id", "pos", "text"), "site", ("page_id", "pos"), "text")
    marked = rows.join(claimed.select("page_id", "pos", "is_unique"), ["page_id", "pos"], "left")
    if language is not None:
        lang = language.select("page_id", T.accepted_language(F.col("lang"), F.col("score")).alias("lang"))
        marked = marked.join(lang, "page_id", "left")
    else:
        marked = marked.withColumn("lang", F.lit("?"))
    marked = marked.withColumn("lang", F.when(F.col("text").isNotNull(), F.coalesce("lang", F.lit("?")))).withColumn("hash", T.block_hash("text"))
    own = marked.where("is_unique IS NOT NULL").withColumn("words", T.words(F.col("text")))
    totals = B.document_words(own, "page_id")
    tongue = B.main_language(own, "page_id", ("pos",))
    heads = pages.select("page_id", "url", "ts", U.site_directory(F.col("url"), scope).alias("site"))
    titles = rows.groupBy("page_id").agg(F.max("title").alias("title"))
    documents = heads.join(totals, "page_id").join(tongue, "page_id", "left").join(titles, "page_id", "left")
    return Extraction(marked, documents)


def write_extraction(done: Extraction, folder: str, preview: bool = False) -> None:
    """Files of each kept document below ``folder/<site>/``: its CSV table, its Markdown, and an HTML preview if wanted."""
    kept = B.keep_documents(done.documents)
    base = F.concat(F.col("site"), F.lit("/"), U.file_path(F.col("url")))
    names = kept.select("page_id", base.alias("base"), F.coalesce("lang", F.lit("?")).alias("lang"))
    name = lambda ext: T.output_name(F.col("base"), F.col("lang"), ext).alias("name")
    rows = done.elements.join(kept.select("page_id"), "page_id", "left_semi")
    title = kept.select(
        "page_id", F.lit(-4).alias("pos"), F.lit("Document").alias("elt_type"), F.lit("Title").alias("cmd"), F.lit(1).alias("nesting_level"), F.coalesce("title", F.lit("")).alias("text"),
        F.coalesce("lang", F.lit("?")).alias("lang"), T.block_hash(F.coalesce("title", F.lit(""))).alias("hash"), F.lit(None).cast("boolean").alias("is_unique"),
        *(F.lit(None).cast("int").alias(n) for n in ("row", "rowspan", "col", "colspan")),
    )
    plain = kept.select(
        "page_id", F.posexplode(F.array(
            F.struct(F.lit("Uri").alias("cmd"), F.col("url").alias("text")),
            F.struct(F.lit("Timestamp").alias("cmd"), F.coalesce(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), F.lit("")).alias("text")),
        )).alias("place", "p"),
    )
    counted = done.elements.where("is_unique IS NOT NULL").withColumn("words", T.words(F.col("text")))
    metadata = B.metadata_words(B.words_by_language(counted, "page_id"), "page_id").join(kept.select("page_id"), "page_id", "left_semi")
    entries = metadata.select("page_id", F.explode(F.map_entries("metadata")).alias("e"))
    made = lambda cmd, text: F.concat(F.lit("Document;"), cmd, F.lit(';1;"'), T.csv_encoded(text), F.lit('"' + ";" * 9))
    wanted = ["page_id", "pos", "elt_type", "cmd", "nesting_level", "text", "lang", "hash", "is_unique", "row", "rowspan", "col", "colspan"]
    lines = render.csv_lines(rows.select(*wanted).unionByName(title)).select("page_id", "pos", "line")
    lines = lines.union(plain.select("page_id", F.col("place") - 3, made(F.col("p.cmd"), F.col("p.text"))))
    lines = lines.union(entries.select("page_id", F.lit(-1), made(F.lit("Metadata"), F.concat(F.col("e.key"), F.lit("="), F.col("e.value")))))
    table = lines.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("body"))
    whole = F.concat(F.lit("\ufeff" + render.CSV_HEADER + "\nDocument;Start;1" + ";" * 10 + "\n"), F.col("body"), F.lit("\nDocument;End;1" + ";" * 10 + "\n"))
    render.write_documents(table.join(names, "page_id").select(name(".dataframe.csv"), whole.alias("text")), folder)
    view = B.unique_view(rows)
    render.write_documents(render.render_documents(view).join(names, "page_id").select(name(".text.md"), "text"), folder)
    if preview:
        render.write_documents(render.render_documents(view, "html").join(names, "page_id").select(name(".preview.html"), "text"), folder)


def build_dataset(spark: SparkSession, folder: str, out: str, domain: str, language: str, year_month: str, least: int = D.MIN_FILES) -> str:
    """Parquet files and card of the documents below ``folder`` in one language, for the sites that have enough of them."""
    texts = files.read_markdown(spark, folder).where(F.col("lang") == language)
    site = F.element_at(F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/"), 1)
    texts = texts.withColumn("website", site).withColumn("key", F.regexp_replace("path", r"\.text\.md$", ""))
    wanted = D.sites_with(texts, "website", "lang", language, least)
    heads = files.read_properties(spark, folder).withColumn("key", F.regexp_replace("path", r"\.dataframe\.csv$", "")).drop("path")
    rows = texts.join(wanted, "website", "left_semi").join(heads, "key", "left")
    made = D.records(rows, "uri", F.expr("try_to_timestamp(timestamp, 'MM/dd/yyyy HH:mm:ss')"), "lang", "title", "text", "website")
    split = checkpointed(D.with_split(made, "Website", F.md5("Uri"), id_col="Uri"))
    D.write_dataset(split, out)
    # one row a split and one a site: the size of the card itself
    examples = {r.split: r.examples for r in D.split_counts(split).collect()}
    sites = [tuple(r) for r in D.website_summary(split, "Website", F.col("PDF"), F.col("Words")).limit(MAX_SITES + 1).collect()]
    if len(sites) > MAX_SITES:
        raise ValueError(f"a card lists at most {MAX_SITES} sites")
    size = spark.read.parquet(out).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    return D.dataset_card(domain, language, year_month, examples, size, sites)
