"""Book directories: the sink that writes them and the source that reads them back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_folder(book_id: str) -> str:
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in os.path.basename(book_id.rstrip("/"))).lstrip(".") or "book"


def write_directories(files: DataFrame, root: str) -> DataFrame:
    """Write every file (book_id, path, and content or text) below ``root``/<book>; ``root`` is a folder
    all executors have mounted. Returns what was written: book_id, path, bytes. Files are written
    beside their place and renamed, so a task that runs twice leaves whole files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for book, path, content in zip(pdf["book_id"], pdf["path"], pdf["content"], strict=True):
                folder = os.path.realpath(os.path.join(root, safe_folder(book)))
                place = os.path.realpath(os.path.join(folder, path))
                if not place.startswith(folder + os.sep):
                    raise ValueError(f"path leaves its book: {path}")
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.{os.getpid()}.part", "wb") as f:
                    f.write(content or b"")
                os.replace(f.name, place)
                sizes.append(len(content or b""))
            yield pdf[["book_id", "path"]].assign(bytes=sizes)

    content = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    return files.select("book_id", "path", content.alias("content")).mapInPandas(write, "book_id string, path string, bytes long")


def write_table(files: DataFrame, path: str) -> None:
    """The same files as a Parquet table by book, for stores without folders of small files."""
    files.repartition("book_id").write.mode("overwrite").parquet(path)


def read_directories(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """book_id (the folder), path and text of every text file of the books below ``root``; with
    ``everything`` other files too, their text null."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader if everything else reader.option("pathGlobFilter", "*.{md,json}")).load(root)
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    is_text = F.col("path").rlike(r"\.(md|json)$")
    return rows.select(F.substring_index(inside, "/", 1).alias("book_id"), F.regexp_replace(inside, "^[^/]*/", "").alias("path"), F.when(is_text, F.decode("content", "UTF-8")).alias("text"))
