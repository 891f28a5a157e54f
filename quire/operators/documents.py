"""Operators over HTML documents held in a column: rows of elements, headings, Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import body_of, parse
from ..functions.markup import ACTIVE_TAGS, markup_of, notes_of, sanitise, table_reason
from ..functions.render import normalised, render, render_body

NODES = "node_id int, parent_id int, ord int, depth int, block int, tag string, attrs map<string,string>, text string"


def per_document(docs: DataFrame, key: str, html: str, made: str, make, fault=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``make(markup)`` yields for each document, with the document's key and the columns ``carry``.

    No document is dropped: where ``make`` fails, the document's row is ``fault(error)``, or the job
    fails if there is no ``fault``.
    """
    kept = (key, *carry)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(wanted)
        for b in batches:
            columns: list[list] = [[] for _ in schema]
            for *own, markup in zip(*(b.column(i).to_pylist() for i in range(len(kept))), b.column(len(kept)), strict=True):
                try:
                    rows = list(make(markup.as_py()))
                except Exception as e:  # noqa: BLE001 - the fault is reported as a row
                    if fault is None:
                        raise
                    rows = [fault(e)]
                for row in rows:
                    for column, value in zip(columns, (*own, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    spark = docs.sparkSession
    wanted = spark.createDataFrame([], f"{kinds}, {made}").schema
    return docs.select(*kept, html).mapInArrow(run, wanted)


def node_rows(markup: str | None):
    """Elements below the body in document order; block counts the body's children."""
    body = body_of(parse(markup))
    numbers = {id(body): (-1, 0, 0)}
    block = 0
    for i, n in enumerate(body.elements()):
        if n is body:
            continue
        parent, depth, _ = numbers[id(n.parent)]
        if n.parent is body:
            block += 1
        numbers[id(n)] = (i, depth + 1, block)
        yield i, parent, i, depth + 1, block, n.tag, list(n.attrs.items()), n.text()


def dom_nodes(docs: DataFrame, key: str, html: str) -> DataFrame:
    return per_document(docs, key, html, NODES, node_rows)


def markdown(docs: DataFrame, key: str, html: str) -> DataFrame:
    return per_document(docs, key, html, "markdown string", lambda m: [(render(m),)])


def titled_markdown(docs: DataFrame, key: str, html: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """title (the first heading of level 1 or 2, null if there is none) and markdown, from one parse."""

    def rows(m: str | None):
        body = body_of(parse(m))
        title = next((n.text().strip() for n in body.elements() if n.tag in {"h1", "h2"}), None)
        return [(title, render_body(body, repair=normalised))]

    return per_document(docs, key, html, "title string, markdown string", rows, carry=carry)


def sanitised(docs: DataFrame, key: str, html: str) -> DataFrame:
    return per_document(docs, key, html, "html string", lambda m: [("".join(map(markup_of, sanitise(body_of(parse(m))).children)),)])


def tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """table_no, rows, columns, reason of every table."""

    def rows(m: str | None):
        from ..functions.markup import cells_of, rows_of

        for i, t in enumerate(n for n in parse(m).elements() if n.tag == "table"):
            yield i, len(rows_of(t)), max((len(cells_of(r)) for r in rows_of(t)), default=0), table_reason(t)

    return per_document(docs, key, html, "table_no int, rows int, columns int, reason string", rows)


def notes(docs: DataFrame, key: str, html: str, source: str = "") -> DataFrame:
    """reference, label, class of every note reference."""
    return per_document(docs, key, html, "reference string, label string, class string", lambda m: [(r.attrs.get("id"), label, kind) for r, _, label, kind in notes_of(body_of(parse(m)), source)])


def headings(docs: DataFrame, key: str, html: str) -> DataFrame:
    """ord, level, id, text of the headings of levels 1 and 2."""

    def rows(m: str | None):
        return [(i, int(n.tag[1]), n.attrs.get("id"), n.text().strip()) for i, n in enumerate(parse(m).elements()) if n.tag in {"h1", "h2"}]

    return per_document(docs, key, html, "ord int, level int, id string, text string", rows)


def yaml_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def front_matter(section_id: Column, title: Column, kind: Column, order: Column, sources: Column) -> Column:
    """Front matter; sources: array<struct<href, fragment>>."""
    lines = F.transform(
        sources,
        lambda s: F.concat(F.lit('  - href: "'), yaml_escaped(s["href"]), F.lit('"'), F.when(F.coalesce(s["fragment"], F.lit("")) != "", F.concat(F.lit("\n    fragment: "), yaml_escaped(s["fragment"]))).otherwise(F.lit(""))),
    )
    block = F.when(F.size(sources) == 0, F.lit("  []")).otherwise(F.array_join(lines, "\n"))
    return F.concat(F.lit("---\nid: "), section_id, F.lit('\ntitle: "'), yaml_escaped(title), F.lit('"\ntype: '), kind, F.lit("\norder: "), order.cast("string"), F.lit("\nsource:\n"), block, F.lit("\n---\n\n"))


def active_counts(nodes: DataFrame, key: str) -> DataFrame:
    """Active elements of each document."""
    return nodes.groupBy(key).agg(F.count_if(F.col("tag").isin(*sorted(ACTIVE_TAGS))).alias("active"))


def sliced(nodes: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """Top-level blocks from the one that holds ``start_id`` to the one that holds ``end_id`` (not included).

    bounds: key, section, start_id, end_id; a null start begins at the first block, a null end runs
    to the last. The last match of the start before the end counts.
    """
    ids = nodes.where(F.element_at("attrs", "id").isNotNull()).select(key, F.element_at("attrs", "id").alias("id"), "block").distinct()
    ends = ids.select(F.col(key).alias("k"), F.col("id").alias("end_id"), F.col("block").alias("b")).groupBy("k", "end_id").agg(F.min("b").alias("end_block"))
    starts = ids.select(F.col(key).alias("k"), F.col("id").alias("start_id"), F.col("block").alias("start_block"))
    b = bounds.alias("b").join(ends.alias("e"), (F.col(f"b.{key}") == F.col("e.k")) & (F.col("b.end_id") == F.col("e.end_id")), "left").select("b.*", "end_block")
    found = b.alias("b").join(starts.alias("s"), (F.col(f"b.{key}") == F.col("s.k")) & (F.col("b.start_id") == F.col("s.start_id")) & (F.col("end_block").isNull() | (F.col("s.start_block") < F.col("end_block"))), "left")
    first = found.groupBy(*(f"b.{c}" for c in bounds.columns), "end_block").agg(F.coalesce(F.max("start_block"), F.lit(1)).alias("start_block"))
    top = nodes.where("depth = 1").select(F.col(key).alias("k"), "block", "tag", "text")
    inside = (F.col("block") >= F.col("start_block")) & (F.col("end_block").isNull() | (F.col("block") < F.col("end_block")))
    return first.join(top, (F.col(key) == F.col("k")) & inside).select(key, "section", "block", "tag", "text")
