"""Rule-based classification: the verdict on a read form, flags of cells, and the class of a form's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import norm

# Kinds of flags that a form is judged by, and what speaks against flattening a form.
FLAGS = ("shape", "serial_mismatch", "domain", "no_ink", "unread_ink", "shift_fixed", "cell_mode", "disagree")
REASONS = {"nested": "nested repeats", "media": "media/geo-centric", "cascading": "%d cascading selects (domains become context-dependent)", "many": "%d sibling repeat groups", "wide": "repeat has %d columns", "card": "no repeat group — card layout needed", "little": "too little paper-mappable content"}
#: Share of anchor marks from which cell positions are trusted, and below which a form is rejected.
TRUST, REJECT = 0.95, 0.5


def in_domain(value: Column, domain: Column) -> Column:
    """Whether a value is empty or one of an array of allowed values, in canonical form."""
    return (norm(value) == "") | F.array_contains(F.transform(domain, norm), norm(value))


def in_range(value: Column, low: float = -1e12, high: float = 1e12, whole: bool = False) -> Column:
    """Whether a text is empty or a number from low to high; a decimal comma is allowed."""
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    fits = number.between(low, high) & ((number == F.floor(number)) if whole else F.lit(True))
    return (F.coalesce(value, F.lit("")) == "") | F.coalesce(fits, F.lit(False))


def echoes_labels(values: Column, labels: Column) -> Column:
    """Whether a row repeats the column labels: at least a third of them, and two at least."""
    same = F.size(F.filter(F.zip_with(values, labels, lambda v, lab: norm(v) == norm(lab)), lambda x: x))
    return same >= F.greatest(F.lit(2), F.floor(F.size(labels) / 3))


def clean_cell(value: Column, is_text: Column) -> Column:
    """Words for nothing become the empty text, unless the column is free text."""
    return F.when(~is_text & F.lower(F.btrim(value)).isin("empty", "blank", "-", "na"), "").otherwise(value)


def agree(first: Column, second: Column) -> Column:
    """Struct (value, disagree) of two readings of a cell: the second where it has one; disagree if both have and differ."""
    differs = (norm(first) != norm(second)) & (norm(first) != "") & (norm(second) != "")
    return F.struct(F.coalesce(F.when(norm(second) != "", second), first).alias("value"), differs.alias("disagree"))


def serial_mismatch(value: Column, row: Column) -> Column:
    """Whether a printed serial number was read as another one; row counts from 0, an unread one mismatches nothing."""
    return (norm(value) != "") & (norm(value) != (row + 1).cast("string"))


def align_to_inked(values: Column, inked: Column) -> Column:
    """The k-th value beside the k-th inked column, only if there are equally many; else null."""
    return F.when(F.size(values) == F.size(inked), F.arrays_zip(inked.alias("col"), values.alias("value")))


def first_flags(cells: DataFrame, flags: DataFrame) -> DataFrame:
    """cells (form, row, col) with the first flag (by pos) of the cell, or else of its whole row (flags with a null col)."""
    firsts = flags.groupBy("form", "row", "col").agg(F.min_by("flag", "pos").alias("flag"), F.min("pos").alias("pos"))
    own = firsts.where("col is not null").select("form", "row", "col", F.struct("pos", "flag").alias("own"))
    row = firsts.where("col is null").select("form", "row", F.struct("pos", "flag").alias("whole"))
    return cells.join(own, ["form", "row", "col"], "left").join(row, ["form", "row"], "left").withColumn("flag", F.least("own", "whole")["flag"]).drop("own", "whole")


def form_verdicts(forms: DataFrame, cells: DataFrame, flags: DataFrame, ink: float = 0.004) -> DataFrame:
    """(form, inked_cells, rows_read, n_<flag>..., verdict).

    forms: form, aligned, corners, integrity. cells: form, row, col, ink, serial. flags: form, row, flag. No inked cell,
    or under half of the anchor marks, is a reject. Untrusted geometry, and any of these, is a review: a serial or shape
    flag; over 10 % of inked cells unread; over 15 % outside their domain, or read differently twice; over 40 % of the
    rows read cell by cell. All else is detected.
    """
    inked = cells.where((F.col("ink") >= ink) & ~F.col("serial"))
    n_inked = inked.groupBy("form").agg(F.count(F.lit(1)).alias("inked_cells"))
    rows = inked.select("form", "row").union(flags.where("row is not null").select("form", "row")).groupBy("form").agg(F.count_distinct("row").alias("rows_read"))
    counted = flags.groupBy("form").agg(*[F.count_if(F.col("flag") == f).alias(f"n_{f}") for f in FLAGS])
    names = ["inked_cells", "rows_read", *[f"n_{f}" for f in FLAGS]]
    all_ = forms.join(n_inked, "form", "left").join(rows, "form", "left").join(counted, "form", "left").fillna(0, names)
    per_cell = lambda f: F.col(f"n_{f}") / F.greatest(F.lit(1), F.col("inked_cells"))
    why = (
        (F.col("n_serial_mismatch") > 0) | (F.col("n_shape") > 0) | (per_cell("unread_ink") > 0.10) | (per_cell("domain") > 0.15)
        | (per_cell("disagree") > 0.15) | (F.col("n_cell_mode") / F.greatest(F.lit(1), F.col("rows_read")) > 0.40)
    )
    verdict = (
        F.when((F.col("inked_cells") == 0) | (F.col("integrity") < REJECT), "reject")
        .when(~F.col("aligned") | ~F.col("corners") | (F.col("integrity") < TRUST) | why, "review")
        .otherwise("detected")
    )
    return all_.select("form", *names, verdict.alias("verdict"))


def layout_class(questions: Column, media: Column, depth: Column, regions: Column) -> Column:
    """The class of a form by its counts; regions: the number of columns of each repeated group.

    In this order: nested repeats or mostly media: not_flattenable; one region of 2 to 12 columns: register; several:
    multi_region; one wider: register_wide; no region and four questions or more: card; else not_flattenable.
    """
    usable = F.filter(regions, lambda n: n >= 2)
    n = F.size(usable)
    return (
        F.when((depth >= 2) | (media > F.greatest(F.lit(2), questions / 2)), "not_flattenable")
        .when((n == 1) & (F.get(usable, F.lit(0)) <= 12), "register").when(n > 1, "multi_region").when(n == 1, "register_wide")
        .when(questions >= 4, "card").otherwise("not_flattenable")
    )


def layout_reasons(questions: Column, media: Column, depth: Column, regions: Column, cascading: Column) -> Column:
    """What speaks against flattening a form, as an array of messages in order, beside the class of layout_class."""
    usable = F.filter(regions, lambda n: n >= 2)
    found = layout_class(questions, media, depth, regions)
    early = (depth >= 2) | (media > F.greatest(F.lit(2), questions / 2))
    return F.array_compact(F.array(
        F.when(depth >= 2, REASONS["nested"]), F.when(media > questions / 2, REASONS["media"]),
        F.when(cascading > 0, F.format_string(REASONS["cascading"], cascading)),
        F.when(found == "multi_region", F.format_string(REASONS["many"], F.size(usable))),
        F.when(found == "register_wide", F.format_string(REASONS["wide"], F.get(usable, F.lit(0)))),
        F.when(found == "card", REASONS["card"]), F.when((found == "not_flattenable") & ~early, REASONS["little"]),
    ))


def template_errors(title: Column, labels: Column, types: Column, rows: Column, orientation: Column, known: tuple[str, ...] = ("serial", "int", "dec", "date", "yn", "choice", "name", "text")) -> Column:
    """What is wrong with a template, as an array of messages; empty if nothing is."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(blank(title), "title is required"), F.when(F.size(labels) == 0, "no columns"),
        F.when(F.exists(labels, blank), "a column has no label"),
        F.when(F.exists(types, lambda t: ~F.coalesce(t, F.lit("")).isin(*known)), "unknown column type"),
        F.when(~F.coalesce(rows.between(1, 60), F.lit(False)), "rows must be from 1 to 60"),
        F.when(~F.coalesce(orientation.isin("portrait", "landscape"), F.lit(False)), "unknown orientation"),
    ))
