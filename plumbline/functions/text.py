"""Column expressions over text: canonical cells, tokens, links, numbers, slugs, hints, lines of CSV, Markdown.

All but the pandas UDF at the end are plain Spark SQL expressions. White space and digits are ASCII in them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns of links, numbers and hints.
URL = r"""https?://[^\s\)\]>"']+"""
NUMBER = r"\d[\d,]*\.?\d*"
ASK_BACK = r"(?i)(which|what|where|could you|can you|please (tell|share|clarify)|need to know)[^.]{0,60}\?"
NO_DATA = (
    r"(?i)(not (publicly )?(available|collected|published)|no (official|public) (data|source|statistics)"
    r"|does ?n.t exist|couldn.t find|could not find|isn.t tracked|not tracked)"
)
FORM_ID = r"\bPR[A-Z2-9]{4}\b"
_SPACE = r"[ \t\n\x0B\f\r]+"
_CELL_NUMBER = r"^[+-]?[0-9]+([.,][0-9]+)?$"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACE, " "))


def norm(c: Column) -> Column:
    """Canonical form of a cell for comparison: '' for null or blank, a plain decimal for numbers, else lower case.

    23, 23.0, "23,0", +23 and 023 are all 23; -0 is 0; a comma is a decimal sign, so 1,234 is 1.234.
    """
    text = collapse(F.coalesce(c.cast("string"), F.lit("")))
    number = F.replace(text, F.lit(","), F.lit("."))
    whole = F.regexp_replace(F.regexp_extract(number, r"^[+-]?([0-9]+)", 1), r"^0+(?=[0-9])", "")
    part = F.regexp_replace(F.regexp_extract(number, r"\.([0-9]+)$", 1), "0+$", "")
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    signed = F.when(text.startswith("-") & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
    return F.when(text.rlike(_CELL_NUMBER), signed).otherwise(F.lower(text))


def atoms(c: Column) -> Column:
    """Tokens of a text as structs (cls, tok): num, word of two letters or more, code of one letter."""
    raw = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z.]+"), lambda t: F.btrim(t, F.lit(".")))

    def classed(t: Column) -> Column:
        cls = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), "num").when((F.length(t) == 1) & t.rlike("[a-z]"), "code").when(F.length(t) >= 2, "word")
        return F.struct(cls.alias("cls"), F.when(cls == "num", norm(t)).otherwise(t).alias("tok"))

    return F.filter(F.transform(raw, classed), lambda a: a["cls"].isNotNull())


def urls(c: Column, most: int = 8) -> Column:
    """The first `most` links, repeats included."""
    return F.slice(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0)), 1, most)


def numbers(c: Column, fixed: bool = False) -> Column:
    """Numbers without their commas. A dot that ends a sentence stays on, as in "2021."; `fixed` drops it."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.transform(found, lambda n: F.rtrim(n, F.lit("."))) if fixed else found


def gold_hit(gold: Column, text: Column, fixed: bool = False) -> Column:
    """Whether a number of gold is among those of text; null if gold has none."""
    wanted = numbers(gold, fixed)
    return F.when(F.size(wanted) == 0, F.lit(None).cast("boolean")).otherwise(F.arrays_overlap(wanted, numbers(text, fixed)))


def all_urls(*texts: Column) -> Column:
    """The different links of several texts, in order of appearance."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0)) for c in texts])))


def form_id(c: Column) -> Column:
    """The first form id in a text, null if it has none."""
    return F.nullif(F.regexp_extract(c, FORM_ID, 0), F.lit(""))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} in it, as text; a null value becomes the empty text, {{ and }} are braces."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name is not None else []
    return F.concat(*parts) if parts else F.lit("")


def field_of_each(c: Column, field: str) -> Column:
    """A map of structs as a map of one of their fields."""
    return F.transform_values(c, lambda _, v: v[field])


def slug(c: Column) -> Column:
    """Lower-case words joined by underscores; "field" if none are left."""
    s = F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", "field").otherwise(s)


def clean_label(c: Column) -> Column:
    """A label without tags, ${...} references and edge marks, at most 40 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), r"\$\{[^}]*\}", "")
    return F.left(F.btrim(bare, F.lit(" :?")), F.lit(40))


def excerpt_end(c: Column, size: int = 600) -> Column:
    """The last `size` characters with white space collapsed."""
    return collapse(F.right(c, F.lit(size)))


#: A code point that no text has, as it stands for no character.
_NEVER = "\ufdd0"


def _outside_quotes(line: Column) -> Column:
    """line split at the commas that have an even number of quotes after them, in one pass over its pieces between quotes."""
    pieces = F.split(line, '"', -1)
    marked = F.transform(pieces, lambda p, i: F.when((F.size(pieces) - i) % 2 == 1, F.replace(p, F.lit(","), F.lit(_NEVER))).otherwise(p))
    return F.split(F.array_join(marked, '"'), _NEVER, -1)


def csv_fields(c: Column, n: int) -> Column:
    """Struct (values, shape_ok) of the first non-blank line without back-ticks, padded or cut to n fields."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "`", ""), "\r?\n"), lambda x: F.btrim(x) != "")
    parts = _outside_quotes(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    bare = F.transform(parts, lambda v: F.replace(F.regexp_replace(F.btrim(v), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    padded = F.slice(F.concat(bare, F.array_repeat(F.lit(""), n)), 1, n)
    return F.struct(padded.alias("values"), (F.size(bare) == n).alias("shape_ok"))


def csv_line(*cells: Column) -> Column:
    """One CSV line: fields with a comma, quote or line break are quoted, quotes doubled."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(x.cast("string"), F.lit("")) for x in cells)]
    return F.concat_ws(",", *quoted)


def html_escape(c: Column) -> Column:
    out = c
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def inline_markdown(c: Column) -> Column:
    """HTML of code, strong, emphasis and links; the text itself is escaped first."""
    out = html_escape(c)
    for pattern, html in ((r"`([^`]+)`", "<code>$1</code>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')):
        out = F.regexp_replace(out, pattern, html)
    return out


def json_object(c: Column) -> Column:
    """From the first { to the last } of a text; null if there is no such part."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def initials(codes: Column) -> Column:
    """First letters of an array of codes, if all are longer than three characters and the letters differ; else codes."""
    first = F.transform(codes, lambda c: F.upper(F.left(c, F.lit(1))))
    usable = F.forall(codes, lambda c: F.length(c) > 3) & (F.size(F.array_distinct(first)) == F.size(codes))
    return F.when(usable, first).otherwise(codes)


def clamp(c: Column, low: int, high: int, default: int) -> Column:
    """The whole number in a text, kept between low and high; default if it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(default))))


def _norm_value(value: object) -> str:
    import re
    import unicodedata

    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", str(value).strip())) if value is not None else ""
    if re.fullmatch(r"[+-]?\d+(?:[.,]\d+)?", text):
        number = float(text.replace(",", "."))
        return str(int(number)) if number == int(number) else repr(number)
    return text.casefold()


@F.pandas_udf(StringType())
def norm_unicode(cells: pd.Series) -> pd.Series:
    """norm with Unicode normalisation and case folding, which Spark SQL has no function for."""
    return cells.map(_norm_value, na_action=None)
