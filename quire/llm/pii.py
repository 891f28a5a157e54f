"""Personal data: base patterns plus information-theoretic term disclosure (built-in functions only).

Base spans are the leftmost non-overlapping matches of four patterns, failing candidates dropped.
Regular expressions are written possessively and start at the start of a run (or where the last
match ended, ``\\G``), which finds the same matches without backtracking or rescanning long runs.

The method: every base span is a protected entity. Terms (runs of letters) inside a window of
``window`` code points around it co-occur with it. Disclosure is estimated for the single entity and
for its kind (all e-mail addresses, all phone numbers, ...). For entity or kind e and term t,

    P(e|t) = (n(e, t) + s * P(e)) / (n(t) + s),

n(t) being all occurrences of t in the corpus, n(e, t) the windows of e that hold it, alike (copies)
or not (n(t) at most), P(e) the share of all term occurrences that lie in e's windows, and s the ``shrink`` that keeps
a term seen once from counting as certain. The pointwise information ``log2(P(e|t) / P(e))`` says how
strongly t reveals e. A term whose P(e|t) and information reach their thresholds is a disclosing term;
for a kind it must also stand near ``support`` different entities. From ``p_remove`` on a term that
discloses an entity is removed, all others are generalised.

Defined results: a null text is empty (no spans); a null id keeps its row; repeated rows get equal
results each; offsets are code points; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, read_table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any accepted match contains; texts without it skip the full pattern.
NEEDED = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
TERM = r"\p{L}++"
#: Up to so many characters of distinct terms are broadcast; more are joined by shuffle.
BROADCAST_CHARS = 16_000_000
SPANS = "array<struct<kind:int,start:int,end:int,entity:string>>"
TERM_SPANS = "array<struct<start:int,end:int,p:double,alone:boolean>>"
#: Items of an array that are folded at once.
PIECE = 128


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def bound(value: Column, body) -> Column:
    """``body(value)``, the value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, step, kind: str) -> Column:
    """The arrays (of type ``kind``) that ``step(at, item) -> (at, array)`` gives, one after the other; ``at`` starts at 0.

    Appending to an array copies it, so pieces of ``PIECE`` items are folded alone and joined at the
    end: the work follows the number of items, not its square.
    """
    none = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        at, put = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], put).alias("out"))

    def outer(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(piece, start, inner, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    def whole(it: Column) -> Column:
        last = F.floor((F.size(it) - 1) / PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(it, i * PIECE + 1, F.lit(PIECE)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(it) > 0, F.aggregate(pieces, zero, outer, lambda a: F.flatten(a["out"]))).otherwise(none)

    return bound(items, whole)


def located(text: Column, kind: str) -> Column:
    """Spans of one kind: lengths of the matches and of the gaps between them add up to offsets."""
    pattern = PATTERNS[kind]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    k = F.lit(KINDS.index(kind))
    none = F.array().cast(SPANS)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(k.alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("entity"))
        return end, F.when(F.coalesce(accepted(kind, x["match"]), F.lit(False)) & x["match"].isNotNull(), F.array(span)).otherwise(none)

    return F.when(text.rlike(NEEDED[kind]), folded(pairs, step, SPANS)).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(*(located(text, k) for k in KINDS))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def context(text: Column, span: Column, window: int) -> Column:
    """The letters around a span, addresses blanked and words cut by the window's edges left out."""
    before = F.substring(text, F.greatest(span["start"] - window, F.lit(0)) + 1, F.least(span["start"], F.lit(window)))
    after = F.substring(text, span["end"] + 1, F.lit(window))
    # The characters just outside: a letter there means that the window cuts a word.
    left = F.when(span["start"] > window, F.substring(text, span["start"] - window, F.lit(1))).otherwise("")
    right = F.substring(text, span["end"] + window + 1, F.lit(1))
    before = F.when(left.rlike(r"\p{L}"), F.regexp_replace(before, r"^\p{L}++", "")).otherwise(before)
    after = F.when(right.rlike(r"\p{L}"), F.regexp_replace(after, r"\p{L}++$", "")).otherwise(after)
    blank = lambda x: F.regexp_replace(x, PATTERNS["email"], " ")
    return F.concat(blank(before), F.lit(" "), blank(after))


def found_in(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, h, spans (base), contexts (kind, entity and the words around it) and the text's digest of each document; the text of those with spans."""
    spanned = docs.select("doc_id", "h", "text", base_spans(F.col("text")).alias("spans"))
    contexts = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["entity"].alias("entity"), context(F.col("text"), s, window).alias("around")))
    some = F.size("spans") > 0
    return durable(spanned.select("doc_id", "h", "spans", F.when(some, contexts).alias("contexts"), F.when(some, F.col("text")).alias("text"), F.sha2(F.col("text").cast("binary"), 256).alias("plain")))


def bounded(terms: DataFrame) -> DataFrame | None:
    """``terms`` marked for broadcast if all its characters fit the bound, else None."""
    chars = terms.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    return F.broadcast(terms) if chars <= BROADCAST_CHARS else None


def term_rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int, p_min: float, bits: float, shrink: float) -> DataFrame:
    """Terms that reveal an entity or a kind: term, alone (an entity, not only a kind), p (the greatest P(e|term)), information in bits."""
    windows = found.select(F.explode("contexts").alias("c")).select("c.kind", "c.entity", "c.around").groupBy("kind", "entity", "around").agg(F.count(F.lit(1)).alias("times"))
    windows = durable(windows)
    total = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(TERM))), F.lit(0))).first()[0]
    words = windows.select("kind", "entity", "times", F.explode(F.array_distinct(F.regexp_extract_all("around", F.lit(TERM), F.lit(0)))).alias("term"))
    per_entity = durable(words.groupBy("kind", "entity", "term").agg(F.sum("times").alias("both")))
    per_kind = per_entity.groupBy("kind", "term").agg(F.sum("both").alias("both"), F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= support)
    near = F.col("times") * F.regexp_count("around", F.lit(TERM))
    prior = F.least(F.greatest(F.sum(near), F.lit(1)) / F.lit(float(max(total, 1))), F.lit(1.0)).alias("prior")
    single = per_entity.join(windows.groupBy("kind", "entity").agg(prior), ["kind", "entity"])
    kinds = per_kind.join(F.broadcast(windows.groupBy("kind").agg(prior)), "kind").withColumn("entity", F.lit(None).cast("string"))  # a row for each kind
    columns = ["kind", "entity", "term", "both", "prior"]
    pairs = single.select(*columns).unionByName(kinds.select(*columns))
    # A term occurs at least as often as it stands in windows, so what falls short of this can't reach the threshold.
    pairs = durable(pairs.where(F.col("both") + shrink * F.col("prior") >= p_min * (F.col("both") + shrink)))
    candidates = pairs.select("term").distinct()
    small = bounded(candidates)
    if small is not None:
        counts = term_rows(docs).join(small, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = term_rows(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(candidates, "term", "left_semi")
    # Overlapping windows may hold the same occurrence.
    p = (F.least("both", "n") + shrink * F.col("prior")) / (F.col("n") + shrink)
    scored = pairs.join(counts, "term").withColumn("p", F.least(p, F.lit(1.0)))
    scored = scored.withColumn("information", F.log2(F.col("p") / F.col("prior")))
    kept = scored.where((F.col("p") >= p_min) & (F.col("information") >= bits))
    return durable(kept.groupBy("term").agg(F.bool_or(F.col("entity").isNotNull()).alias("alone"), F.max("p").alias("p"), F.max("information").alias("information")))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, h, text, term_spans: every occurrence of a disclosing term in the documents that hold one."""
    terms = terms.select("term", "p", "alone")
    small = bounded(terms)
    if small is not None:
        # Only pointers to the text pass the explode; rows are made for hits alone.
        once = docs.select("doc_id", "h", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term"))
        hits = once.join(small, "term")
    else:
        pairs = term_rows(docs, "doc_id", "h").distinct().join(terms, "term")
        hits = docs.alias("d").join(pairs.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h"))).select("d.doc_id", "d.h", "d.text", "term", "p", "alone")
    gaps = F.transform(F.split("text", F.concat(F.lit(r"(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})")), -1), lambda g: F.length(g))
    size = F.length("term")
    # A term's k-th occurrence starts after k gaps and k - 1 earlier occurrences.
    step = lambda at, g: (at + g + size, F.array(F.struct((at + g).alias("start"), (at + g + size).alias("end"), F.col("p").alias("p"), F.col("alone").alias("alone"))))
    spans = folded(bound(gaps, lambda g: F.slice(g, F.lit(1), F.size(g) - 1)), step, TERM_SPANS)
    found = hits.select("doc_id", "h", "text", spans.alias("s"))
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("term_spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 80, support: int = 3, p_min: float = 0.6, bits: float = 4.0, shrink: float = 1.0) -> DataFrame:
    """One row per document: doc_id, h (hash of its text), spans (base), term_spans (added by the method),
    plain (the text's digest), and the text of documents that have any span."""
    keyed = with_key(docs, id_col, text_col)
    found = found_in(keyed, window)
    none = F.array().cast(TERM_SPANS)
    terms = disclosing_terms(keyed, found, support, p_min, bits, shrink)
    if terms.isEmpty():
        return found.select("doc_id", "h", "spans", none.alias("term_spans"), "plain", "text")
    added = term_spans(keyed, terms)
    same = F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.h") == F.col("a.h"))
    joined = found.alias("f").join(added.alias("a"), same, "left")
    return joined.select("f.doc_id", "f.h", "f.spans", F.coalesce("a.term_spans", none).alias("term_spans"), "f.plain", F.coalesce("f.text", "a.text").alias("text"))


def sanitised_text(p_remove: float = 0.9) -> Column:
    """The text of a row of :func:`find_pii` without what it discloses: base spans become ``[KIND]``;
    disclosing terms become ``[TERM]`` or, if they disclose an entity from ``p_remove`` on, nothing."""
    names = ", ".join(repr(f"[{k.upper()}]") for k in KINDS)
    base = F.expr(f"transform(spans, s -> struct(s.start, s.end, element_at(array({names}), s.kind + 1) AS put))")
    term = F.expr(f"transform(term_spans, s -> struct(s.start, s.end, IF(s.alone AND s.p >= {p_remove}, '', '[TERM]') AS put))")
    text, none = F.col("text"), F.array().cast("array<string>")

    def step(at: Column, c: Column) -> tuple[Column, Column]:
        # Cuts in order of start; one that begins inside an earlier cut is covered by it.
        inside = c["start"] < at
        return F.greatest(at, c["end"]), F.when(inside, none).otherwise(F.array(F.substring(text, at + 1, c["start"] - at), c["put"]))

    def made(cuts: Column) -> Column:
        rest = F.substring(text, F.array_max(F.transform(cuts, lambda c: c["end"])) + 1, F.length(text))
        return F.concat(F.array_join(folded(cuts, step, "array<string>"), ""), rest)

    return F.when(F.size("spans") + F.size("term_spans") > 0, bound(F.sort_array(F.concat(base, term)), made)).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p_remove: float = 0.9, **options) -> DataFrame:
    """doc_id, sanitised of every document; see :func:`sanitised_text`."""
    found = find_pii(docs, id_col, text_col, **options).where(F.size("spans") + F.size("term_spans") > 0).distinct()
    keyed = with_key(docs, id_col, text_col).alias("d")
    match = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h"))
    cut = found.select("doc_id", "h", sanitised_text(p_remove).alias("made")).alias("f")
    return keyed.join(cut, match, "left").select("d.doc_id", F.coalesce("f.made", "d.text").alias("sanitised"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    base = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    terms = F.transform("term_spans", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    counts = [F.size(F.filter("spans", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
        F.size("term_spans").cast("long").alias("n_terms"),
        F.when(F.size("spans") + F.size("term_spans") > 0, F.sha2(sanitised_text().cast("binary"), 256)).otherwise(F.col("plain")).alias("sanitised_sha256"),
    )
