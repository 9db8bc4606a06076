"""Queries of the problems, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, language, mixing, mojibake, neardup, packing, quality, repeated, residue, spam

Query = Callable[[SparkSession, str], DataFrame]

#: Bound, for each language, of the fixed tables of samples and words that are collected to train and to tell words.
MAX_FIXED_ROWS = 1_000
#: Bound of the list of common words, which is used whole.
MAX_COMMON_WORDS = 100_000


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


def _fixed(spark: SparkSession, path: str, table: str, *names: str) -> list[tuple]:
    """Rows of a fixed table in order, at most MAX_FIXED_ROWS of each language."""
    rows = spark.read.parquet(f"{path}/{table}.parquet").select("lang", *(n for n in names if n != "lang"))
    got = rows.limit(MAX_FIXED_ROWS + 1).collect()
    if len(got) > MAX_FIXED_ROWS:  # else all of them are within the bound
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*names))
        got = rows.withColumn("_rank", rank).where(F.col("_rank") <= MAX_FIXED_ROWS).collect()
    return sorted((tuple(r[n] for n in names) for r in got), key=lambda x: [v or "" for v in x])


def _common_words(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.parquet(f"{path}/common_words.parquet").select("word").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return [r.word for r in rows if r.word]


def _clean_sample(spark: SparkSession, path: str) -> list[str]:
    return [t for (t,) in _fixed(spark, path, "lang_samples", "text") if t] + [w for _, w in _fixed(spark, path, "common_words", "lang", "word") if w]


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    return boilerplate.frame_lines(_docs(spark, path))


def p1_main_text(spark: SparkSession, path: str) -> DataFrame:
    return boilerplate.main_text(_docs(spark, path))


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    return residue.residue_documents(_docs(spark, path))


def p2_messages(spark: SparkSession, path: str) -> DataFrame:
    """Masked messages with the number of their sources and documents."""
    return residue.residue_messages(residue.residue_signs(_docs(spark, path)))


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    return repeated.repeated_lines(_docs(spark, path))


def p3_block_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of blocks of two and more lines that span many documents of their root as blocks."""
    return repeated.repeated_block_lines(_docs(spark, path))


def p3_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return repeated.without_repeated_lines(_docs(spark, path))


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    return quality.document_kinds(_docs(spark, path), _clean_sample(spark, path))


def p4_statistics(spark: SparkSession, path: str) -> DataFrame:
    return quality.quality_statistics(_docs(spark, path), _common_words(spark, path))


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    members, links = neardup.near_duplicates(_docs(spark, path), threshold=0.6, size=3, min_words=50, plain=True)
    return neardup.duplicate_pairs(members, links)


def p5_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class and number of linked classes of each document, for five-word shingles and a weighted similarity of 0.8; documents
    without text are classes of their own, and shorter ones are alike if their words are."""
    docs = _docs(spark, path)
    members, links = neardup.near_duplicates(docs, short=True)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    own = members.join(degree, "rep", "left").withColumnRenamed("id", "doc_id")
    every = docs.select("doc_id").distinct().join(own, "doc_id", "left")
    return every.select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_links(spark: SparkSession, path: str) -> DataFrame:
    """Links between the representatives of classes, of which :func:`p5_classes` gives the members."""
    return neardup.near_duplicates(_docs(spark, path))[1].select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("weighted", 4).alias("similarity"))


def _languages(spark: SparkSession, path: str, without_residue: bool = False, stretches: bool = False) -> DataFrame:
    words = _fixed(spark, path, "common_words", "lang", "word")
    tagger = language.train(_fixed(spark, path, "lang_samples", "lang", "text"), words, language.labelled_words(_docs(spark, path)))
    return language.document_languages(_docs(spark, path), tagger, _clean_sample(spark, path), without_residue=without_residue, stretches=stretches)


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    return language.label_faults(_languages(spark, path, without_residue=True))


def p6_languages(spark: SparkSession, path: str) -> DataFrame:
    """Language of each document and of each run of words in another one."""
    return _languages(spark, path, stretches=True).withColumn("confidence", F.round("confidence", 4))


def p7_found(spark: SparkSession, path: str) -> DataFrame:
    return mojibake.garbled_lines(_docs(spark, path)).select("doc_id", "line_no").distinct()


def p7_restored(spark: SparkSession, path: str) -> DataFrame:
    return mojibake.garbled_lines(_docs(spark, path))


def p7_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles that were decoded wrongly, with the original where it can be had."""
    return mojibake.garbled_lines(_docs(spark, path), text_col="title")


def p8_packed(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, path), spark.read.parquet(f"{path}/pack_specs.parquet"))


def p8_report(spark: SparkSession, path: str) -> DataFrame:
    return packing.packing_report(p8_packed(spark, path), spark.read.parquet(f"{path}/pack_specs.parquet"))


def p8_faults(spark: SparkSession, path: str) -> DataFrame:
    """Documents placed in each pack, and what breaks its rules."""
    return packing.packing_faults(_docs(spark, path), p8_packed(spark, path), spark.read.parquet(f"{path}/pack_specs.parquet"))


def p9_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, path), spark.read.parquet(f"{path}/mix_targets.parquet"))[0]


def p9_shares(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, path), spark.read.parquet(f"{path}/mix_targets.parquet"))[1]


def p9_full_mix(spark: SparkSession, path: str) -> DataFrame:
    """Mixes of the size of all that their sources have: small sources are clamped at their repeats."""
    return mixing.mix_sources(_docs(spark, path), spark.read.parquet(f"{path}/mix_targets.parquet"), mixing.EVERYTHING)[0]


def p9_full_shares(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, path), spark.read.parquet(f"{path}/mix_targets.parquet"), mixing.EVERYTHING)[1]


def p9_faults(spark: SparkSession, path: str) -> DataFrame:
    """What breaks the rules of the clamped mixes, for each source."""
    return mixing.mixing_faults(mixing.mix_sources(_docs(spark, path), spark.read.parquet(f"{path}/mix_targets.parquet"), mixing.EVERYTHING)[1])


def p10_found(spark: SparkSession, path: str) -> DataFrame:
    return spam.spam_documents(_docs(spark, path), sample=_clean_sample(spark, path))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_main_text, p2_found, p2_messages, p3_found, p3_block_lines, p3_cleaned, p4_found, p4_statistics, p5_found, p5_classes, p5_links, p6_found,
        p6_languages, p7_found, p7_restored, p7_titles, p8_packed, p8_report, p8_faults, p9_mix, p9_shares, p9_full_mix,
        p9_full_shares, p9_faults, p10_found,
    )
}
