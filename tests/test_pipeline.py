from __future__ import annotations

import glob

from pyspark.sql import functions as F

from corpusloom.plans import pipeline


def test_extract_write_and_make_a_dataset(spark, tmp_path):
    pages = [(i, f"http://www.h.example/p/{i}?a={i}", f"<title>T{i}</title><h1>Titre {i}</h1><p>commun</p><p>texte {i} seul</p><ul><li>x{i}</li></ul>") for i in range(60)]
    pages.append((99, "http://www.h.example/p/dup", "<p>commun</p>"))
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("ts", F.to_timestamp(F.lit("2023-01-04 11:27:13")))
    language = table.select("page_id", F.lit("__label__fr").alias("lang"), F.lit(0.9).alias("score"))
    done = pipeline.extract(table, "subdomain", language)
    assert done.documents.where("unique_words = 0").count() == 1 and {r.lang for r in done.documents.collect()} == {"fr"}
    pipeline.write_extraction(done, str(tmp_path / "site"), preview=True)
    names = glob.glob(f"{tmp_path}/site/**/*.fr.*", recursive=True)
    assert len(names) == 180
    first = next(n for n in names if "/p/0_" in n and n.endswith(".text.md"))
    assert open(first).read() == "# Titre 0\n\ncommun\n\ntexte 0 seul\n\n- x0\n\n\n"
    other = next(n for n in names if "/p/1_" in n and n.endswith(".text.md"))
    assert "commun" in open(other).read()  # a group that is kept keeps its repeated blocks
    card = pipeline.build_dataset(spark, str(tmp_path / "site"), str(tmp_path / "out"), "demo", "fr", "2301")
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 60 and {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 48, "valid": 6, "test": 6}
    one = rows.where("Title = 'T0'").first()
    assert one.Uri == "http://www.h.example/p/0?a=0" and one.Timestamp == "01/04/2023 11:27:13" and one.Words == 9  # the marks of headings and items count
    assert "num_examples: 48" in card and "| www.h.example | 60 | 0 |" in card


def test_tables_of_documents_have_heads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://www.h.example/p", '<title>A "title" here</title><p>one text</p><p>two</p>')], "page_id bigint, url string, html string").withColumn("ts", F.to_timestamp(F.lit("2023-01-04 11:27:13")))
    done = pipeline.extract(pages, "subdomain", pages.select("page_id", F.lit("__label__fr").alias("lang"), F.lit(0.9).alias("score")))
    pipeline.write_extraction(done, f"file://{tmp_path}/site")
    (name,) = glob.glob(f"{tmp_path}/site/**/*.fr.dataframe.csv", recursive=True)
    lines = open(name, encoding="utf-8").read().split("\n")
    assert lines[0].startswith("\ufeffDocEltType;") and lines[1] == "Document;Start;1" + ";" * 10
    assert lines[2].startswith('Document;Title;1;"A ""title"" here";fr;14;3;3;') and lines[3].startswith('Document;Uri;1;"http://www.h.example/p"')
    assert lines[4].startswith('Document;Timestamp;1;"01/04/2023 11:27:13"') and lines[5].startswith('Document;Metadata;1;"words-count:fr=3"') and lines[-2] == "Document;End;1" + ";" * 10
