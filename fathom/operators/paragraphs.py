"""Paragraphs of books with running chapter numbers, as windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fathom.functions.text import clean_book_text, is_chapter_title, stem


def paragraphs(files: DataFrame, file: str = "source_file", text: str = "text") -> DataFrame:
    """(paragraph_id, source_file, book, chapter, paragraph_index, text) of each file.

    A title or a blank line ends a paragraph; each title starts the next chapter, and what precedes
    the first counts as chapter 1. Windows run within a file, which is one row to begin with.
    """
    lines = files.select(F.col(file).alias("source_file"), F.posexplode(F.split(clean_book_text(F.coalesce(F.col(text), F.lit(""))), "\n", -1)).alias("seq", "line"))
    order = Window.partitionBy("source_file").orderBy("seq")
    lines = lines.withColumn("title", is_chapter_title(F.trim("line")) & (F.trim("line") != ""))
    lines = lines.withColumn("ends", F.col("title") | (F.trim("line") == ""))
    lines = lines.withColumn("chapter", F.greatest(F.sum(F.col("title").cast("int")).over(order), F.lit(1))).withColumn("part", F.sum(F.col("ends").cast("int")).over(order))
    joined = lines.where("not ends").groupBy("source_file", "chapter", "part").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    joined = joined.where("text <> ''")
    index = F.row_number().over(Window.partitionBy("source_file", "chapter").orderBy("part"))
    book = F.nullif(F.regexp_extract("source_file", r"(?i)book\s*_?(\d+)", 1), F.lit("")).cast("int")
    rows = joined.select("source_file", book.alias("book"), "chapter", index.alias("paragraph_index"), "text")
    named = F.concat(F.coalesce(F.concat(F.lit("book_"), F.col("book").cast("string")), F.lower(stem(F.col("source_file")))), F.format_string("_chapter_%d_paragraph_%d", "chapter", "paragraph_index"))
    return rows.select(named.alias("paragraph_id"), "source_file", "book", "chapter", "paragraph_index", "text")
