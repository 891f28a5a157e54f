"""Queries of the classifier on titles that reach every branch."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import classify as C

TITLES = """
SELECT p_partkey, CASE p_partkey % 30
  WHEN 0 THEN 'Cover' WHEN 1 THEN 'Table of Contents' WHEN 2 THEN 'Title Page' WHEN 3 THEN 'Copyright' WHEN 4 THEN 'Dedication'
  WHEN 5 THEN 'A Foreword' WHEN 6 THEN 'Preface' WHEN 7 THEN 'Acknowledgements' WHEN 8 THEN 'Introduction' WHEN 9 THEN 'Appendix A'
  WHEN 10 THEN 'Glossary' WHEN 11 THEN 'Works Cited' WHEN 12 THEN 'Index' WHEN 13 THEN 'Colophon' WHEN 14 THEN 'About the Author'
  WHEN 15 THEN 'Also Available' WHEN 16 THEN 'See Chapter 9' WHEN 17 THEN 'Part 2' WHEN 18 THEN '12. The Road' WHEN 19 THEN 'XIV'
  WHEN 20 THEN 'Mix tape' WHEN 21 THEN 'Chapter 3' WHEN 22 THEN '.' WHEN 23 THEN '' WHEN 24 THEN 'THE BOOK' WHEN 25 THEN 'Discovery'
  ELSE p_name END AS title, p_partkey AS k
FROM part
"""



def rule_sql(x: str, what: int) -> str:
    values = [f"'{k}'" if what == 1 else f"CAST({c} AS DOUBLE)" for _, k, c in C.RULES]
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN {v}" for (p, _, _), v in zip(C.RULES, values, strict=True)) + " END"


def map_sql(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PROPERTY_TYPES.items()) + " END"


def label_sql(x: str) -> str:
    low = f"lower({x})"
    token = f"regexp_extract({low}, '[^#:]*$')"
    return f"CASE WHEN {low} IN ('cover', 'other.ms-coverimage-standard', 'other.ms-coverimage') THEN 'cover' ELSE coalesce({map_sql(low)}, {map_sql(token)}) END"


@query("classify_rules", f"SELECT p_partkey, {rule_sql('title', 1)} AS type, {rule_sql('title', 2)} AS confidence FROM ({TITLES})")
def classify_rules(t):
    return t.sql(TITLES).select("p_partkey", C.rule(F.col("title"))["type"].alias("type"), C.rule(F.col("title"))["confidence"].alias("confidence"))


LABELS = """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Cover' WHEN 1 THEN 'http://x.org/vocab#TitlePage' WHEN 2 THEN 'z:index'
  WHEN 3 THEN 'bodymatter chapter' WHEN 4 THEN 'other.ms-coverimage' WHEN 5 THEN 'acknowledgements' WHEN 6 THEN 'cover-image' WHEN 7 THEN 'nothing' ELSE 'Part' END AS label
FROM part
"""


@query("classify_property", f"SELECT p_partkey, {label_sql('label')} AS type FROM ({LABELS})")
def classify_property(t):
    return t.sql(LABELS).select("p_partkey", C.label_type(F.col("label")).alias("type"))


@query("numbered_chapter", f"SELECT p_partkey, regexp_matches(title, '{C.NUMBERED}') AS numbered FROM ({TITLES})")
def numbered_chapter(t):
    return t.sql(TITLES).select("p_partkey", C.numbered(F.col("title")).alias("numbered"))


FILES = """
SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN 'x_cover' WHEN 1 THEN 'about_the_author' WHEN 2 THEN 'bm2' WHEN 3 THEN 'toc' WHEN 4 THEN 'fm1'
    WHEN 5 THEN 'in1_b' WHEN 6 THEN 'index' WHEN 7 THEN 'c-ata' WHEN 8 THEN 'prf' WHEN 9 THEN 'contents' WHEN 10 THEN 'booksby' ELSE 'ch' END AS item_id,
  CASE p_partkey % 3 WHEN 0 THEN 'EPUB/toc.xhtml' ELSE concat('EPUB/f', cast(p_partkey AS string), '.xhtml') END AS href, p_size % 2 = 0 AS index_before
FROM part
"""


def file_sql(what: int) -> str:
    pick = lambda k, c: f"'{k}'" if what == 1 else f"CAST({c} AS DOUBLE)"
    name = "concat(item_id, ' ', href)"
    cases = [f"WHEN regexp_matches(lower({name}), '{C.COVER_NAME}') THEN {pick('cover', 0.65)}"]
    cases += [f"WHEN regexp_matches(lower({name}), '{p}') THEN {pick(k, c)}" for p, k, c in C.FILE_NAMES]
    cases += [f"WHEN regexp_matches(lower({name}), '{C.INDEX_NAME}') AND index_before THEN {pick('index', 0.6)}"]
    return "CASE " + " ".join(cases) + f" ELSE {rule_sql(name, what)} END"


@query("classify_filename", f"SELECT p_partkey, {file_sql(1)} AS type, {file_sql(2)} AS confidence FROM ({FILES.replace('AS string', 'AS varchar')})")
def classify_filename(t):
    made = C.file_name_evidence(F.col("item_id"), F.col("href"), F.lit("x"), F.col("index_before"))
    return t.sql(FILES).select("p_partkey", made["type"].alias("type"), made["confidence"].alias("confidence"))


SECTIONS = f"""
SELECT p_partkey, title, concat('id', cast(k % 5 AS string)) AS item_id, concat('EPUB/s', cast(k % 7 AS string), CASE k % 11 WHEN 3 THEN ' cover' ELSE '' END, '.xhtml') AS href,
  CASE k % 8 WHEN 1 THEN 'epub:glossary' WHEN 2 THEN 'scripted' END AS property,
  CASE k % 12 WHEN 5 THEN 'toc' WHEN 6 THEN 'bodymatter' WHEN 7 THEN 'index' END AS landmark,
  CASE k % 6 WHEN 1 THEN title WHEN 2 THEN 'The preface to it' WHEN 3 THEN 'Dedication' END AS nav,
  CASE k % 14 WHEN 4 THEN 'cover' WHEN 5 THEN 'text' END AS guide,
  CASE k % 10 WHEN 6 THEN 'IV. Home' WHEN 7 THEN 'glossary' END AS ncx,
  CASE k % 4 WHEN 1 THEN 'Appendix B' WHEN 2 THEN '7 Days' END AS heading
FROM ({TITLES}) q
"""


def sections_sql() -> str:
    first = []

    def case(condition: str, kind: str, source: str, confidence: str) -> None:
        first.append((condition, kind, f"'{source}'", confidence))

    case(map_sql("regexp_extract(lower(property), '[^#:]*$')") + " IS NOT NULL", map_sql("regexp_extract(lower(property), '[^#:]*$')"), "epub:type", "0.95")
    for s, c in C.SOURCES:
        case(label_sql(s) + " IS NOT NULL", label_sql(s), s, str(c))
    for s in ("nav", "ncx", "title", "heading"):
        case(f"regexp_matches({s}, '{C.NUMBERED}')", "'chapter'", s, "0.82")
    for s, c in C.SOURCES:
        case(rule_sql(s, 1) + " IS NOT NULL", rule_sql(s, 1), s, f"{c} + {rule_sql(s, 2)} / 100")
    for s in ("title", "heading"):
        case(rule_sql(s, 1) + " IS NOT NULL", rule_sql(s, 1), "heading", rule_sql(s, 2))
    name = "concat(item_id, ' ', href)"
    case(f"regexp_matches(lower({name}), '{C.COVER_NAME}') OR trim(title) = '.'", "'cover'", "filename", "0.65")
    case(rule_sql(name, 1) + " IS NOT NULL", rule_sql(name, 1), "filename", rule_sql(name, 2))
    case("trim(title) IN ('', '.') OR lower(trim(title)) = 'the book'", "'other'", "filename", "0.35")
    columns = []
    for i, (alias, default) in enumerate((("type", "'chapter'"), ("source", "'spine'"), ("confidence", "0.4")), 1):
        value = "CASE " + " ".join(f"WHEN {c[0]} THEN {f'CAST({c[i]} AS DOUBLE)' if i == 3 else c[i]}" for c in first) + f" ELSE {default} END"
        columns.append(f"{f'round(CAST({value} AS DOUBLE), 6)' if i == 3 else value} AS {alias}")
    return f"SELECT p_partkey, {', '.join(columns)} FROM ({SECTIONS.replace('AS string', 'AS varchar')})"


@query("classify_sections", sections_sql())
def classify_sections(t):
    c = F.col
    made = C.classified(c("title"), c("item_id"), c("href"), F.array(c("property")), c("landmark"), c("nav"), c("guide"), c("ncx"), c("heading"), F.lit("The Book"), F.lit(False))
    rows = t.sql(SECTIONS).withColumn("made", made)
    return rows.select("p_partkey", "made.type", "made.source", F.round("made.confidence", 6).alias("confidence"))
