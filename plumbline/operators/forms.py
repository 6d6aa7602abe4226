"""Survey forms as rows (form, pos, type, ...): counts of what they ask, their regions and class, and table templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators.rules import layout_class, layout_reasons
from plumbline.operators.sequences import nesting

# Kinds of questions, of media, and the column type that each simple question becomes.
QUESTIONS = ("select", "text", "integer", "decimal", "date", "datetime", "time")
MEDIA = ("image", "audio", "video", "geopoint", "geotrace", "geoshape", "file", "barcode")
COLUMN_TYPES = {"text": "text", "integer": "int", "decimal": "dec", "date": "date", "datetime": "date", "time": "text"}
YES_NO = ("yes", "no", "y", "n")


def plain_type(c: Column) -> Column:
    """A question's type in lower case with spaces for underscores."""
    return F.replace(F.lower(F.btrim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit(" "))


def _filled(c: str) -> Column:
    return F.count_if(F.btrim(F.coalesce(F.col(c), F.lit(""))) != "")


def form_features(rows: DataFrame) -> DataFrame:
    """One row per form: questions, select_one, select_multiple, media, skip_logic, constraints, cascading, repeats, max_depth, regions, class, reasons.

    rows: form, pos, type, relevant, constraint, choice_filter. regions: for each repeat that closes at depth one, the
    questions since the last begin, so those of an outer repeat before a nested one do not count.
    """
    kind = plain_type(F.col("type"))
    base = F.regexp_extract(kind, "^([a-z]*)", 1)
    typed = rows.withColumn("__kind", kind).withColumn("__base", base)
    begin, end = F.col("__kind") == "begin repeat", F.col("__kind") == "end repeat"
    deep = nesting(typed, "form", ["pos"], begin, end)
    w = Window.partitionBy("form").orderBy("pos")
    asks = F.col("__base").isin(*QUESTIONS) & ~begin & ~end
    deep = deep.withColumn("__before", F.lag("depth", 1, 0).over(w)).withColumn("__inside", F.sum((asks & (F.col("depth") >= 1)).cast("int")).over(w))
    deep = deep.withColumn("__open", F.last(F.when(begin, F.col("__inside")), ignorenulls=True).over(w))
    region = F.when(end & (F.col("__before") == 1), F.struct("pos", (F.col("__inside") - F.col("__open")).cast("int").alias("n")))
    multiple = F.contains("__kind", F.lit("multiple"))
    found = deep.groupBy("form").agg(
        F.count_if(asks).alias("questions"), F.count_if((F.col("__base") == "select") & ~multiple).alias("select_one"), F.count_if((F.col("__base") == "select") & multiple).alias("select_multiple"),
        F.count_if(F.col("__base").isin(*MEDIA)).alias("media"), _filled("relevant").alias("skip_logic"), _filled("constraint").alias("constraints"), _filled("choice_filter").alias("cascading"),
        F.count_if(begin).alias("repeats"), F.max("depth").alias("max_depth"), F.sort_array(F.collect_list(region)).alias("__regions"),
    )
    found = found.withColumn("regions", F.transform("__regions", lambda r: r["n"])).drop("__regions")
    shape = [F.col(c) for c in ("questions", "media", "max_depth", "regions")]
    return found.withColumn("class", layout_class(*shape)).withColumn("reasons", layout_reasons(*shape, F.col("cascading")))


def header_names(sheets: DataFrame, key: str = "path", fields: str = "fields") -> DataFrame:
    """(key, name): the names that any row of a sheet has, once each; rows hold a map from name to value."""
    return sheets.select(key, F.explode(F.map_keys(fields)).alias("name")).distinct()


def languages(names: DataFrame, key: str = "path") -> DataFrame:
    """(key, languages): how many headers of a form are labels in a language of their own (label::...)."""
    return names.groupBy(key).agg(F.count_if(F.col("name").startswith("label::")).alias("languages"))


def with_form_id(slugs: DataFrame, ids: DataFrame, slug: str = "slug") -> DataFrame:
    """slugs with the form id that the list gives each; those without one go."""
    return slugs.join(ids.select(slug, "form_id").distinct(), slug)


def by_column_type(scores: DataFrame, columns: DataFrame) -> DataFrame:
    """(type, columns, cell_acc): the mean cell accuracy of each type of template column, over columns that hold anything.

    scores: form, col, filled, cell_acc; columns: form, label, type. Scores of labels that no template column has, and
    columns without a score, count for nothing.
    """
    joined = columns.join(scores.where("filled > 0").withColumnRenamed("col", "label"), ["form", "label"])
    return joined.groupBy("type").agg(F.count(F.lit(1)).alias("columns"), F.round(F.avg("cell_acc"), 4).alias("cell_acc"))


def choice_lists(choices: DataFrame, most: int = 8) -> DataFrame:
    """(list_name, codes): the first `most` choices of each list in order."""
    place = F.row_number().over(Window.partitionBy("list_name").orderBy("pos", "name"))  # Spark limits ranks before it shuffles
    first = choices.select("list_name", "pos", "name").withColumn("__place", place).where(F.col("__place") <= most)
    return first.groupBy("list_name").agg(F.sort_array(F.collect_list(F.struct("__place", "name"))).alias("all")).select("list_name", F.col("all.name").alias("codes"))


def table_columns(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """(form, pos, label, type, domain): the columns that the questions of a form give a table.

    Questions that choose one from a list take its codes as domain, abbreviated where they can be; lists of yes and no
    are yn; a list that does not exist drops the question, as do types that no column has.
    """
    kind = plain_type(F.col("type"))
    asked = rows.select("form", "pos", fx.clean_label(F.col("label")).alias("label"), kind.alias("kind"), F.regexp_extract(F.col("type"), r"^\s*select_one\s+(\S+)", 1).alias("list_name"))
    simple = F.create_map(*[F.lit(x) for pair in COLUMN_TYPES.items() for x in pair])
    plain = asked.where(F.col("kind").isin(*COLUMN_TYPES)).select("form", "pos", "label", simple[F.col("kind")].alias("type"), F.array().cast("array<string>").alias("domain"))
    chosen = asked.where("list_name <> ''").join(choice_lists(choices), "list_name")
    yes_no = F.size(F.array_except(F.transform("codes", F.lower), F.array(*[F.lit(x) for x in YES_NO]))) == 0
    picks = chosen.select("form", "pos", "label", F.when(yes_no, "yn").otherwise("choice").alias("type"), F.when(yes_no, F.array(F.lit("Y"), F.lit("N"))).otherwise(fx.initials(F.col("codes"))).alias("domain"))
    return plain.unionByName(picks)


def value_kind(column_type: Column) -> Column:
    """The kind of value that a column type holds: amount, code, text or other."""
    return F.when(column_type.isin("int", "dec"), "amount").when(column_type.isin("choice", "yn"), "code").when(column_type.isin("name", "text"), "text").otherwise("other")
