"""References, paths and names as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Schemes a link may keep.
ALLOWED_SCHEMES = ("http", "https", "mailto")


def ref_path(href: Column) -> Column:
    """What stands before the first ``#``."""
    return F.substring_index(href, "#", 1)


def ref_fragment(href: Column) -> Column:
    """What follows the first ``#``; null if nothing does."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.nullif(F.substring(href, at + 1, F.length(href)), F.lit("")))


def folded(segments: Column, start: Column) -> Column:
    """Walk path segments from ``start``: empty ones and ``.`` stay, ``..`` goes up and stops at the root."""
    return F.aggregate(
        segments,
        start,
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.regexp_replace(acc, "/?[^/]*$", ""))
        .otherwise(F.when(acc == "", s).otherwise(F.concat(acc, F.lit("/"), s))),
    )


def normal_path(path: Column) -> Column:
    return folded(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(""))


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded as UTF-8; ``+`` stays, and so does a text with broken escapes."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.instr(text, "%") > 0, F.coalesce(decoded, text)).otherwise(text)


def joined_path(base: Column, href: Column) -> Column:
    """A reference seen from a base file: package path, fragment kept; absolute URLs stay as they are."""
    absolute = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("//")
    path, fragment = percent_decoded(ref_path(href)), ref_fragment(href)
    folder = F.when(F.instr(base, "/") > 0, F.regexp_replace(base, "/[^/]*$", "")).otherwise(F.lit(""))
    inside = F.array_join(F.filter(F.split(folder, "/"), lambda s: s != ""), "/")
    joined = F.when(path == "", normal_path(base)).when(path.startswith("/"), normal_path(path)).otherwise(folded(F.split(path, "/"), inside))
    return F.when(absolute, href).when(fragment.isNotNull(), F.concat(joined, F.lit("#"), fragment)).otherwise(joined)


def uri_scheme(href: Column) -> Column:
    """The scheme in lower case, empty if there is none before the first slash."""
    return F.lower(F.regexp_extract(href, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def link_policy(href: Column) -> Column:
    """keep (an allowed scheme), drop (another one) or resolve (inside the publication)."""
    scheme = uri_scheme(href)
    return F.when(scheme == "", "resolve").when(scheme.isin(*ALLOWED_SCHEMES), "keep").otherwise("drop")


def safe_url(value: Column) -> Column:
    """Whether a URL attribute may stay: no line break or tab near its start, an allowed scheme or none."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(trimmed, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return ~F.substring(trimmed, 1, 32).rlike("[\r\n\t]") & ((scheme == "") | scheme.isin(*ALLOWED_SCHEMES))


def relative_path(source: Column, target: Column) -> Column:
    """The way from one output file to another."""
    here = F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1)
    there = F.split(target, "/")
    # A common prefix may take all of both sides, as folders and files are compared alike.
    same = F.aggregate(
        F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, eq: F.struct((acc["n"] + F.when(acc["go"] & eq, 1).otherwise(0)).alias("n"), (acc["go"] & eq).alias("go")),
        lambda acc: acc["n"],
    )
    ups = F.array_repeat(F.lit(".."), F.size(here) - same)
    return F.array_join(F.concat(ups, F.slice(there, same + 1, F.size(there))), "/")


@F.pandas_udf(StringType())
def ascii_folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII (Spark has no normalisation function)."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slug(text: Column, fallback: Column | str = "section") -> Column:
    """ASCII slug; only texts with other characters pass through Python."""
    plain = F.when(text.rlike("^[\\x00-\\x7F]*$"), text).otherwise(ascii_folded(text))
    made = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(made)


def name_tokens(item_id: Column, href: Column) -> Column:
    """Alphanumeric tokens of an item's id and reference."""
    return F.split(F.lower(F.concat(item_id, F.lit(" "), href)), "[^a-z0-9]+")


def file_stem(href: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(href, "/", -1), r"\.[^.]*$", ""))
