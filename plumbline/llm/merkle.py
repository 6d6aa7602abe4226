"""A Merkle manifest of a table: leaves by row, one tree a group, one tree over the groups' roots, proofs by lookup.

Rows are numbered in their group by a range partitioning and sums over partitions, so a group of any size is spread over
many tasks. Nodes are folded some levels at a time and written as a table of (tree, level, at). Each leaf explodes the
coordinates of its siblings, which follow from its index and its group's size alone, joins the node table, puts them in
order and folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, fold

#: Nodes of one run, and levels that are folded in one grouping (3^5 = 243 nodes meet in one row).
ARITY, _LEVELS = 3, 5
#: Nodes that are broadcast at most, from the top level down (10 MB); those below meet the leaves in a join by coordinate.
BROADCAST_NODES = 1 << 17
#: Powers of three up to 2^62: their number bounds the levels of any tree.
_POWERS = "array(" + ", ".join(f"{ARITY**k}L" for k in range(40)) + ")"


@dataclass
class Manifest:
    """What a verifier needs: the rows with their places, the groups with their roots, and all nodes below the roots."""

    rows: DataFrame  #: the given columns; tree (number of the group), i (index in it), n (rows in it)
    groups: DataFrame  #: tree, subroot, siblings (of the subroot, in order)
    nodes: DataFrame  #: tree, level, at, digest: nodes of the groups' trees, leaves at level 0
    n_groups: int
    root: bytes | None  #: none for a table without rows


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the number of powers of three below n."""
    return F.size(F.filter(F.expr(_POWERS), lambda p: p < n))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with tree (the group's number, groups in order, null first), i (index along `order`, null first) and n.

    Rows are dealt by ranges of group and order, so that a group may span tasks; only the counts of a task's groups are
    summed over tasks. Rows equal in all of these are interchangeable.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    spread = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__place"), 33)
    pieces = spread.groupBy(part.alias("__part"), F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("m"), F.min("__place").alias("begin"))
    along = Window.partitionBy("__group").orderBy("__part")
    pieces = pieces.withColumn("before", F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("__group")))
    pieces = durable(pieces)
    # Groups are numbered in the task where they begin, from the number of groups that begin in earlier tasks on.
    begins = pieces.where("before = 0")
    tasks = begins.groupBy("__part").agg(F.count(F.lit(1)).alias("g"))
    tasks = tasks.withColumn("base", F.coalesce(F.sum("g").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a task
    first = begins.withColumn("k", F.row_number().over(Window.partitionBy("__part").orderBy("begin"))).join(tasks, "__part").select(F.col("__group").alias("__named"), (F.col("base") + F.col("k") - 1).alias("tree"))
    known = pieces.join(first, F.col("__group").eqNullSafe(F.col("__named"))).select("__part", "__group", "begin", "before", "n", "tree")
    placed = spread.withColumn("__of", part).join(known, (F.col("__of") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return placed.select(*rows.columns, "tree", (F.col("__place") - F.col("begin") + F.col("before")).alias("i"), "n")


def _folded(layer: Column) -> Column:
    """The digests of an array's runs of three."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(layer) / ARITY).cast("int") - 1)
    return F.transform(starts, lambda s: digest(_joined(F.slice(layer, s * ARITY + 1, ARITY))))


def node_table(leaves: DataFrame, largest: int) -> DataFrame:
    """(tree, level, at, digest) of all nodes, from leaves (tree, i, n, digest) of trees of at most `largest` leaves.

    A grouping gathers 243 neighbours of one level and folds five levels, so a tree of n leaves takes log3(n) / 5 of them,
    each over a 243th of the rows of the one before.
    """
    tables = [leaves.select("tree", F.lit(0).alias("level"), F.col("i").alias("at"), "digest", "n")]
    done, below = 0, tables[0]
    while ARITY**done < largest:
        block = F.expr(f"at div {ARITY**_LEVELS}").alias("block")
        met = below.where(F.col("n") > ARITY**done).groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("all"))
        met = met.withColumn("l0", F.col("all.digest"))
        for k in range(1, _LEVELS + 1):
            met = met.withColumn(f"l{k}", _folded(F.col(f"l{k - 1}")))
        found = met.select("tree", "n", "block", F.posexplode(F.array(*[f"l{k}" for k in range(1, _LEVELS + 1)])).alias("k", "layer"))
        found = found.select("tree", "n", "block", "k", F.posexplode("layer").alias("j", "digest"))
        at = F.expr(f"block * element_at({_POWERS}, {_LEVELS} - k) + j")
        found = found.select("tree", (F.col("k") + 1 + done).alias("level"), at.alias("at"), "digest", "n")
        below = durable(found.where(F.expr(f"element_at({_POWERS}, level) < n")))  # levels up to the root's
        tables.append(below)
        below, done = below.where(F.col("level") == done + _LEVELS), done + _LEVELS
    all_ = tables[0]
    for other in tables[1:]:
        all_ = all_.unionByName(other)
    return all_


def _wanted(leaves: DataFrame, low: int, high: int) -> DataFrame:
    """(tree, i, level, at): the coordinates of each leaf's siblings in levels low to high - 1."""
    own, runs = f"(i div {_POWERS}[k])", f"((n + {_POWERS}[k] - 1) div {_POWERS}[k])"
    layer = f"transform(filter(array(0L, 1L, 2L), r -> {own} div 3 * 3 + r <> {own} and {own} div 3 * 3 + r < {runs}), r -> named_struct('level', k, 'at', {own} div 3 * 3 + r))"
    some = leaves.withColumn("h", F.least(height(F.col("n")), F.lit(high))).where(F.col("h") > low)
    return some.select("tree", "i", F.expr(f"inline(flatten(transform(sequence({low}, h - 1), k -> {layer})))"))


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, i, siblings): the digests of each leaf's siblings, level by level and left to right, from (tree, i, n).

    Nodes of the upper levels, which most leaves ask for, are broadcast as far as BROADCAST_NODES reaches; a node below
    is asked for by no more leaves than lie under its run, which the same bound keeps to a small share of all. Trees of
    one leaf have no row.
    """
    counts = {row["level"]: row["m"] for row in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("m")).collect()}  # a row a level
    top, cut, held = max(counts, default=0) + 1, max(counts, default=0) + 1, 0
    while cut > 0 and held + counts.get(cut - 1, 0) <= BROADCAST_NODES:
        cut, held = cut - 1, held + counts.get(cut - 1, 0)
    by = ["tree", "level", "at"]
    plain = nodes.select(*by, "digest")
    found = _wanted(leaves, cut, top).join(F.broadcast(plain.where(F.col("level") >= cut)), by)
    if cut > 0:
        found = found.unionByName(_wanted(leaves, 0, cut).join(plain.where(F.col("level") < cut), by))
    return found.groupBy("tree", "i").agg(F.sort_array(F.collect_list(F.struct("level", "at", "digest"))).alias("s")).select("tree", "i", F.col("s.digest").alias("siblings"))


def fold_proof(leaf: Column, i: Column, n: Column, siblings: Column) -> Column:
    """The root that leaf i of n and its siblings lead to; a tree of one leaf has that leaf as its root."""
    h = height(n)
    begin = F.struct(leaf.alias("cur"), F.lit(0).alias("used"), i.cast("long").alias("i"), n.cast("long").alias("n"))

    def up(s: Column, _: Column) -> Column:
        left = F.pmod(s["i"], F.lit(ARITY)).cast("int")
        run = F.least(F.lit(ARITY).cast("long"), s["n"] - s["i"] + left).cast("int")
        text = F.concat(_joined(F.slice(siblings, s["used"] + 1, left)), hexed(s["cur"]), _joined(F.slice(siblings, s["used"] + 1 + left, run - left - 1)))
        third = lambda v: F.call_function("div", v, F.lit(ARITY))
        return F.struct(digest(text).alias("cur"), (s["used"] + run - 1).alias("used"), third(s["i"]).alias("i"), third(s["n"] + (ARITY - 1)).alias("n"))

    return F.when(h > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(h, F.lit(1))), begin, up, lambda s: s["cur"])).otherwise(leaf)


def build(rows: DataFrame, group_col: str, order_col: str, leaf_col: str) -> Manifest:
    """The manifest of rows whose digest (32 bytes) is in leaf_col, one tree a value of group_col, along order_col.

    Null is a group of its own, the first; within a group null comes first, and rows with one value of order_col follow
    their digests. Repeated rows are leaves of their own. A table without rows has no root. Columns named tree, i or n
    are the operator's: give others another name.
    """
    # What the leaves were made from is read once: dealing by ranges looks at its input twice.
    placed = durable(numbered(durable(rows), group_col, [order_col, leaf_col]))
    leaves = placed.select("tree", "i", "n", F.col(leaf_col).alias("digest"))
    largest = leaves.agg(F.max("n")).first()[0]
    if largest is None:
        none = placed.select("tree", F.col(leaf_col).alias("subroot"), F.array(F.col(leaf_col)).alias("siblings"))
        return Manifest(placed, none, leaves.select("tree", F.lit(0).alias("level"), F.col("i").alias("at"), "digest"), 0, None)
    nodes = node_table(leaves, largest)
    subroots = durable(nodes.where(F.col("level") == height(F.col("n"))).select("tree", F.col("digest").alias("subroot")))
    n = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"))
    upper = node_table(tops, n)
    root = bytes(upper.where(F.col("level") == height(F.col("n"))).first()["digest"])
    up = proofs(tops, upper).select(F.col("i").alias("tree"), "siblings")
    groups = durable(subroots.join(up, "tree", "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<binary>"))))
    return Manifest(placed, groups, nodes.select("tree", "level", "at", "digest"), n, root)


def prove(manifest: Manifest) -> DataFrame:
    """The manifest's rows with subroot, siblings (up to the subroot) and upper (from there to the root), in order."""
    siblings = proofs(manifest.rows.select("tree", "i", "n"), manifest.nodes)
    groups = manifest.groups.withColumnRenamed("siblings", "upper")
    groups = F.broadcast(groups) if manifest.n_groups <= BROADCAST_NODES // 16 else groups
    proved = manifest.rows.join(siblings, ["tree", "i"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<binary>")))
    return proved.join(groups, "tree")


def verify(proved: DataFrame, claim_col: str, manifest: Manifest) -> DataFrame:
    """proved with folded_root, what the digest in claim_col and the row's proof lead to, and verified."""
    sub = fold_proof(F.col(claim_col), F.col("i"), F.col("n"), F.col("siblings"))
    folded = proved.withColumn("__sub", sub).withColumn("folded_root", fold_proof(F.col("__sub"), F.col("tree"), F.lit(manifest.n_groups), F.col("upper"))).drop("__sub")
    return folded.withColumn("verified", F.col("folded_root") == F.lit(manifest.root))


def document_leaf(text: Column) -> Column:
    """The digest of a document's fields, with this text."""
    return digest(F.concat(*[framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], framed(text)))


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose crc32 of the id is even are read again without their line feeds, as tampering would leave them; their
    proofs are those of the documents as they were. Null texts stay null, and a text without line feeds stays as it is
    and is verified. A null id counts as the empty string there, and comes first in its source; very long texts cost
    one pass; other columns are ignored; an empty table gives no rows.
    """
    changed = F.when(fold(F.col("doc_id"), 2) == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", document_leaf(F.col("text")).alias("leaf"), document_leaf(changed).alias("claim"))
    manifest = build(rows, "source", "doc_id", "leaf")
    checked = verify(prove(manifest), "claim", manifest)
    proof = F.sha2(_joined(F.concat("siblings", "upper")).cast("binary"), 256)
    root = F.hex(F.lit(manifest.root)) if manifest.root else F.lit("")
    return checked.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lower(root).alias("root"), proof.alias("proof_sha256"), hexed(F.col("folded_root")).alias("folded_root"), "verified")

