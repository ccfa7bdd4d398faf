"""Folders of text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_folder(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("md", "markdown", "txt", "html")) -> DataFrame:
    """(url, title, markdown) of every file of these kinds below path; the title is the file's name."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(kinds) + "}")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.input_file_name().alias("url"), F.url_decode(F.regexp_replace(name, r"\.[^.]+$", "")).alias("title"), F.col("value").alias("markdown"))
