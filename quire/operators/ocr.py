"""Recovering text from images: results of an analyser as rows, and the decision what to replace."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that keep an image, that are passed over, and that hold text.
VISUAL_LABELS = ("image", "figure", "chart", "seal", "header_image", "footer_image")
IGNORED_LABELS = ("number", "header", "footer", "aside_text")
TEXT_LABELS = (
    "text",
    "content",
    "paragraph_title",
    "doc_title",
    "abstract",
    "reference",
    "references",
    "footnote",
    "figure_title",
    "figure_caption",
    "table_title",
    "table_caption",
    "figure_table_title",
    "formula_number",
)
RESULT = "struct<res:struct<parsing_res_list:array<struct<block_label:string,block_content:string>>>,parsing_res_list:array<struct<block_label:string,block_content:string>>>"


def label(name: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")


def math_stripped(formula: Column) -> Column:
    """A formula without the delimiters around it."""
    x = F.trim(formula)
    for left, right, n in (("$$", "$$", 2), ("\\[", "\\]", 2), ("\\(", "\\)", 2), ("$", "$", 1)):
        inner = F.trim(F.substring(x, F.lit(n + 1), F.length(x) - 2 * n))
        x = F.when(x.startswith(left) & x.endswith(right) & (F.length(x) > 2 * n), F.concat(F.lit("\x00"), inner)).otherwise(x)
    return F.regexp_replace(x, "^\x00+", "")


def blocks(results: DataFrame, json: str = "json") -> DataFrame:
    """``results`` with items: array<struct<label, content, kind>> of what the analyser found; null if it found nothing."""
    parsed = F.from_json(json, RESULT)
    items = F.coalesce(parsed["res"]["parsing_res_list"], parsed["parsing_res_list"])

    def typed(x: Column) -> Column:
        name, content = label(x["block_label"]), F.trim(F.coalesce(x["block_content"], F.lit("")))
        table = F.lower(content).startswith("<table")
        kind = (
            F.when(name == "", "unknown")
            .when(name.isin(*IGNORED_LABELS), "ignored")
            .when(name.isin(*VISUAL_LABELS), "visual")
            .when(name.isin(*TEXT_LABELS), F.when(content == "", "ignored").otherwise("text"))
            .when(name == "table", F.when(table, "table").otherwise("unknown"))
            .when(name == "formula", F.when(content == "", "unknown").otherwise("formula"))
            .otherwise("unknown")
        )
        return F.struct(name.alias("label"), F.when(name == "formula", math_stripped(content)).otherwise(content).alias("content"), kind.alias("kind"))

    return results.withColumn("items", F.transform(items, typed))


def decided(found: DataFrame) -> DataFrame:
    """decision and reason: anything visual or unknown keeps the image."""
    has = lambda kind: F.exists("items", lambda x: x["kind"] == kind)
    usable = F.exists("items", lambda x: x["kind"].isin("text", "table", "formula"))
    reason = F.when(F.col("items").isNull(), "missing-parsing-results").when(has("visual"), "visual-content-present").when(has("unknown"), "unsupported-labels").when(~usable, "no-convertible-content").otherwise("markdown-representable")
    return found.withColumn("reason", reason).withColumn("decision", F.when(reason == "markdown-representable", "replace").otherwise("preserve"))


def with_analyses(images: DataFrame, analyses: DataFrame, key: tuple[str, ...] = ("book_id", "src")) -> DataFrame:
    """``images`` with the decision of their analysis, and a code where there is none."""
    code = F.when(F.col("decision").isNull(), "IMAGE_ANALYSIS_MISSING")
    return images.join(analyses.select(*key, "decision"), list(key), "left").withColumn("code", code)


def analysed(images: DataFrame, analyser: Callable[[dict[str, bytes]], dict[str, str]], key: str = "href", content: str = "content") -> DataFrame:
    """The plug-in point: ``analyser`` maps a batch of images to JSON results. If it fails, the batch
    keeps its images and carries the error."""

    def run(batches):
        for pdf in batches:
            try:
                found, error = analyser(dict(zip(pdf[key], pdf[content], strict=True))), None
            except Exception as e:  # noqa: BLE001 - a failing analyser must not stop a conversion
                found, error = {}, f"{type(e).__name__}: {e}"
            yield pd.DataFrame({key: pdf[key], "json": [found.get(k) for k in pdf[key]], "error": error})

    return images.select(key, content).mapInPandas(run, f"{key} string, json string, error string")
