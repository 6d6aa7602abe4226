"""A prefix trie of conversations, built in parts: what conversations share from their first turn on, and what that saves.

Turns become digests, equal conversations become one path, and paths are grouped by their first turn. Groups of few turns
are dealt by hash into bins; in a bin a dictionary trie of pointers is built and summed up by an iterative postorder. A
group of many turns is one node (or a run of nodes without a branch), and its paths are grouped again by their next turn,
until every part is small; the sums of the parts then go up to these nodes in one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, fold, scratch_folder

#: Turns of a group from which it is grouped again by the next turn; turns that a bin aims at.
MOST_TURNS, BIN_TURNS = 5_000, 20_000
#: Ids that are packed into one row before their digest is taken in order.
_PACKED = 1_000
_NOTHING = hashlib.sha256(b"").digest()
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) from (conv_id, turn, role, text): digests of role and text, and bytes of text, turn by turn.

    Null turns come first, turns of one number follow their digests; null role or text is empty; rows without conv_id
    belong to no conversation. Only digests are shuffled; a conversation is one row, of 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.unhex(F.sha2(framed.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.digest").alias("path"), F.col("t.bytes").alias("sizes"))


def rebuilt_paths(paths: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Each path with its first h turns taken from the first of its family, h = crc32(conv_id) % heads.

    The family of c begins at c - c % family; if that has fewer turns, all are taken, and none if there is no such path.
    """
    paths = durable(paths)
    first = paths.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__base"), *[F.slice(c, 1, heads - 1).alias(f"__{c}") for c in ("path", "sizes")])
    own = paths.withColumn("__of", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", fold(F.col("conv_id"), heads).cast("int"))
    both = own.join(first, F.col("__of") == F.col("__base"), "left")
    none = {"path": F.array().cast("array<binary>"), "sizes": F.array().cast("array<bigint>")}
    grown = lambda c: F.concat(F.slice(F.coalesce(f"__{c}", none[c]), 1, F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return both.select("conv_id", grown("path"), grown("sizes"))


def _ids_in_order(members: DataFrame) -> DataFrame:
    """(key, ends): the digest of each key's ids, ascending and joined by commas.

    Ids are sorted by ranges over all tasks and packed there, so that the one running digest a key reads a thousandth of
    the rows, a batch at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for k, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(ids) == _PACKED:
                    close()
                    key, ids = k, []
                ids.append(conv_id)
            if out:
                yield _batch(out, ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])
                out = []
        close()
        if out:
            yield _batch(out, ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((key, state.digest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield _batch(out, ["key", "ends"], [pa.binary(), pa.binary()])
                out = []
        if state is not None:
            yield _batch([(key, state.digest())], ["key", "ends"], [pa.binary(), pa.binary()])

    packs = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, sizes, n, low, ends): equal paths as one, with their number, smallest id and the digest of all ids."""
    key = F.unhex(F.sha2(F.array_join(F.transform("path", F.hex), "").cast("binary"), 256))
    keyed = durable(paths.select(key.alias("key"), "conv_id", "path", "sizes"))
    once = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.first("path").alias("path"), F.first("sizes").alias("sizes")))
    several = once.where("n > 1").select(F.col("key").alias("__key"))
    members = durable(keyed.join(several, F.col("key") == F.col("__key")).select("key", "conv_id"))
    ends = _ids_in_order(members)
    alone = once.where("n = 1").withColumn("ends", F.unhex(F.sha2(F.col("low").cast("string").cast("binary"), 256)))
    return durable(alone.unionByName(once.where("n > 1").join(ends, "key")).drop("key"))


def subtries(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bin's paths below the nodes (up_low, cut) that they hang from, with top for those just below."""
    tops: dict[tuple[int, int], dict[bytes, int]] = {}
    kids: list[dict[bytes, int]] = []
    depth, above, size, n, low, ends = [], [], [], [], [], []
    for up_low, cut, path, sizes, m, least, digest in part[["up_low", "cut", "path", "sizes", "n", "low", "ends"]].itertuples(index=False):
        at, level = -1, tops.setdefault((up_low, cut), {})
        for k in range(cut, len(path)):
            node = level.get(path[k])
            if node is None:
                node = level[path[k]] = len(kids)
                for column, value in ((kids, {}), (depth, k + 1), (above, at), (size, sizes[k]), (n, 0), (low, least), (ends, None)):
                    column.append(value)
            n[node] += m
            low[node] = min(low[node], least)
            at, level = node, kids[node]
        ends[at] = digest
    leaves, saved, rows = [0] * len(kids), [0] * len(kids), []
    for (up_low, cut), firsts in tops.items():
        stack = [(node, False) for node in firsts.values()]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(kid, False) for kid in kids[node].values()]
                continue
            below = kids[node].values()
            leaves[node] = sum(leaves[k] for k in below) if below else 1
            saved[node] = (n[node] - 1) * size[node] + sum(saved[k] for k in below)
            top = above[node] < 0
            rows.append((low[node], depth[node], up_low if top else low[above[node]], n[node], len(below), leaves[node], saved[node], ends[node], top, cut))
    return pd.DataFrame(rows, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "top", "cut"])


def _shared(a: Column, b: Column) -> Column:
    """How many turns two paths share from their first on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _taken_apart(work: DataFrame, units: list[DataFrame], folder: str, most_turns: int, bin_turns: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of all small groups, and the number of branches of each node taken apart; those nodes join units."""
    small, branches = [], []
    key = ["up_low", "cut", "next"]
    spark = work.sparkSession
    while True:
        work = work.withColumn("next", F.col("path")[F.col("cut")])
        groups = durable(work.groupBy(*key).agg(F.sum((F.size("path") - F.col("cut")).cast("long")).alias("turns"), F.count(F.lit(1)).alias("m")))
        branches.append(groups.groupBy("up_low", "cut").agg(F.count(F.lit(1)).alias("n_children")))
        heavy = groups.where((F.col("turns") > most_turns) & (F.col("m") > 1)).select(*key, F.lit(True).alias("heavy"))
        if heavy.limit(1).count() == 0:
            small.append(work)
            break
        marked = durable(work.join(heavy, key, "left"))
        small.append(marked.where("heavy is null").drop("heavy"))
        inside = marked.where("heavy")
        here = inside.groupBy(*key).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min("path").alias("a"), F.max("path").alias("b"), F.first("sizes").alias("sizes"), F.first("spine").alias("spine"))
        here = here.select(*key, "n", "low", _shared(F.col("a"), F.col("b")).alias("end"), "sizes", "spine")
        here = durable(here.withColumn("spine", F.concat("spine", F.array(F.struct("low", F.col("end").alias("cut"))))))
        apart = inside.drop("spine").join(here.select(*key, F.col("low").alias("of_low"), "end", "spine"), key)
        ended = apart.where(F.size("path") == F.col("end")).select(*key, "ends")  # one path a group at most
        run = here.join(ended, key, "left").select("low", F.col("end").alias("cut"), (F.col("cut") + 1).alias("top"), F.slice("sizes", F.col("cut") + 1, F.col("end") - F.col("cut")).alias("sizes"), "n", "ends", "up_low", "spine")
        units.append(durable(run))
        # Written and read again: a checkpoint would carry what the plan knows of its columns from round to round.
        rest = apart.where(F.size("path") > F.col("end")).select("path", "sizes", "n", "low", "ends", F.col("end").alias("cut"), F.col("of_low").alias("up_low"), "spine")
        rest.write.parquet(f"{folder}/{len(units)}")
        work = spark.read.parquet(f"{folder}/{len(units)}")

    dealt = _union(small)
    turns = dealt.agg(F.sum((F.size("path") - F.col("cut")).cast("long"))).first()[0] or 0
    bins = max(-(-turns // bin_turns), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select("up_low", "cut", "path", "sizes", "n", "low", "ends", F.pmod(F.xxhash64(*key), F.lit(bins)).alias("bin"))
    return durable(dealt.groupBy("bin").applyInPandas(subtries, f"{_NODE}, top boolean, cut int")), _union(branches)


def prefix_trie(paths: DataFrame, most_turns: int = MOST_TURNS, bin_turns: int = BIN_TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, path, sizes), conv_ids distinct.

    conv_id (smallest member) and depth name a node; parent_conv_id; n_convs; n_children; n_leaves and saved_tokens over
    its subtree, its own included; ends: SHA-256 of the ids that end at it. The root has depth 0. Conversations without
    turns are members of the root; equal conversations are members of the same nodes; no conversations give no rows.

    Each round takes the groups of over most_turns turns apart at their next branch, wherever it is; a group of one path
    is never taken apart. Rounds follow the branches along the heaviest path; only counts reach the driver.
    """
    whole = distinct_paths(paths)
    at_root = F.max(F.when(F.size("path") == 0, F.col("ends"))).alias("ends")
    root = durable(whole.agg(F.sum("n").alias("n"), F.min("low").alias("low"), at_root).where("n is not null"))
    # Nodes that are taken apart: a run of nodes from depth `top` on without a branch, its last one at depth `cut`.
    units = [root.select("low", F.lit(0).alias("cut"), F.lit(0).alias("top"), F.array(F.lit(0).cast("long")).alias("sizes"), "n", "ends", F.lit(None).cast("long").alias("up_low"), F.array(F.struct("low", F.lit(0).alias("cut"))).alias("spine"))]
    begin = root.select(F.col("low").alias("up_low"), F.array(F.struct("low", F.lit(0).alias("cut"))).alias("spine"))
    work = whole.where(F.size("path") > 0).withColumn("cut", F.lit(0)).crossJoin(F.broadcast(begin))  # one row
    with scratch_folder(paths.sparkSession, "trie") as folder:
        nodes, branches = _taken_apart(work, units, folder, most_turns, bin_turns)
        branches = durable(branches)

    # What hangs from each of the nodes taken apart goes up to all of those above it.
    units = durable(_union(units))
    direct = nodes.where("top").groupBy(F.col("parent_conv_id").alias("low"), "cut").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    summed = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    own = units.select("low", "cut", "spine", ((F.col("n") - 1) * summed).alias("own")).join(direct, ["low", "cut"], "left")
    lifted = own.select(F.explode("spine").alias("u"), "low", "cut", "own", "leaves", "saved")
    itself = (F.col("u.low") == F.col("low")) & (F.col("u.cut") == F.col("cut"))
    totals = lifted.groupBy("u").agg(F.sum(F.coalesce("leaves", F.lit(0))).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0)) + F.when(itself, 0).otherwise(F.col("own"))).alias("below"))
    totals = totals.select(F.col("u.low").alias("low"), F.col("u.cut").alias("cut"), "leaves", "below")
    known = units.join(totals, ["low", "cut"]).join(branches.select(F.col("up_low").alias("low"), "cut", "n_children"), ["low", "cut"], "left")
    last = F.size("sizes") - 1
    along = known.select("*", F.posexplode("sizes").alias("j", "bytes"))
    after = F.aggregate(F.slice("sizes", F.col("j") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda s, x: s + x)
    upper = along.select(
        F.col("low").alias("conv_id"), (F.col("top") + F.col("j")).alias("depth"), F.when(F.col("j") == 0, F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("j") < last, 1).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
        # A root without turns below it is a leaf.
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * after).alias("saved_tokens"), F.when(F.col("j") == last, F.col("ends")).alias("ends"),
    )
    return nodes.select(*upper.columns).unionByName(upper).withColumn("ends", F.coalesce("ends", F.lit(_NOTHING)))


def _union(tables: list[DataFrame]) -> DataFrame:
    first = tables[0]
    for other in tables[1:]:
        first = first.unionByName(other)
    return first


def rebuilt_trie_report(turns: DataFrame, most_turns: int = MOST_TURNS, bin_turns: int = BIN_TURNS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, as in prefix_trie; ends_sha256 is hexadecimal.

    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    nodes = prefix_trie(rebuilt_paths(turn_paths(turns.select("conv_id", "turn", "role", "text"))), most_turns, bin_turns)
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *counts, F.lower(F.hex("ends")).alias("ends_sha256"))
