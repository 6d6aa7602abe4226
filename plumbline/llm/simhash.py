"""SimHash near-duplicate groups with BK-trees.

Fingerprints within `radius` bits differ in at most `radius` of b blocks of the 64 bits, so they agree on some b - radius
blocks: those bits are the shard key, and each shard of distinct fingerprints gets a BK-tree of its own. Trees travel
through the shuffle beside their queries, as all trees together grow with the corpus and so have no proven size for a
broadcast. A shard that holds more than `tree_size` fingerprints becomes several trees, and every pair of its parts is a
task of its own, so no tree and no task grows with a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, rows_of
from plumbline.llm.components import connected_components

#: Bytes of text whose words are held at once.
SEGMENT = 1 << 20
#: Bit values of each byte, for counting set bits by column.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _word_runs(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of raw in order, some `size` bytes at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of text, repeats included; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_runs(text.encode("utf-8", "replace").lower(), SEGMENT):
        words = tail + words
        if len(words) >= shingle:
            hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64)
            total += len(hashes)
            for column, octets in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
                counts[8 * column : 8 * column + 8] += np.bincount(octets, minlength=256) @ _BITS
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, fp long): a hash of the text and the fingerprint's 64 bits as a signed long.

    Null text counts as empty, whose fingerprint is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = rows_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


class BKTree:
    """Distinct 64-bit integers; each child hangs from its parent by their Hamming distance."""

    def __init__(self, values: list[int]):
        self.root: tuple[int, dict] | None = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while distance := (node[0] ^ value).bit_count():
            if (child := node[1].get(distance)) is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Every member at `radius` bits or fewer from value; only edges that can lead to one are followed."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            member, children = open_nodes.pop()
            distance = (member ^ value).bit_count()
            if distance <= radius:
                found.append(member)
            if children:
                low, high = distance - radius, distance + radius
                open_nodes += [child for edge, child in children.items() if low <= edge <= high]
        return found


def _spanning(tree: BKTree, queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links between tree members and queries; one for each step that joins two groups, the rest follow from them."""
    group: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := group.get(x, x)) != x:
            group[x] = group.get(up, up)
            x = up
        return x

    for query in queries:
        for member in tree.within(query, radius):
            if (a := top(query)) != (b := top(member)):
                group[max(a, b)] = min(a, b)
    for x in list(group):
        if (root := top(x)) != x:
            yield root, x


def _shard_masks(count: int, radius: int, per_shard: int) -> list[int]:
    """Masks of b - radius of b blocks, for the least b at which `count` fingerprints spread to `per_shard` a shard."""
    blocks = next((b for b in range(radius + 1, radius + 5) if count <= per_shard << (64 * (b - radius) // b)), radius + 4)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def fingerprint_links(nodes: DataFrame, radius: int = 4, per_shard: int = 32, tree_size: int = 2048) -> DataFrame:
    """Links (a, b) between the distinct longs of column fp that, closed transitively, link exactly those within radius.

    What it costs: a fingerprint goes to as many shards as there are choices of b - radius of b blocks, 5 for up to about
    130,000 fingerprints, then 15, 35 and 70 at most. A shard of n > tree_size fingerprints is searched by about
    (n / tree_size)^2 / 2 tasks, and a fingerprint in it is sent to n / tree_size of them: exact, and quadratic only in
    distinct fingerprints that agree on all bits of a shard's key.
    """
    masks = _shard_masks(nodes.count(), radius, per_shard)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "key"))
    # A shard of more than tree_size fingerprints is cut into parts; each pair of parts (p <= q) is one unit of work.
    sizes = shards.groupBy("mask", "key").count().where(F.col("count") > 1)
    sized = shards.join(sizes, ["mask", "key"]).withColumn("parts", F.ceil(F.col("count") / tree_size).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = sized.withColumn("part", part).select(
        "mask", "key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("mask", "key", "fp", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for batch in batches:
                mask, key, p, q, in_part, fps = (batch.column(i).to_pylist() for i in range(6))
                yield from zip(zip(mask, key, p, q, strict=True), in_part, fps, strict=True)

        for (_, _, p, q), unit in groupby(members(), key=lambda m: m[0]):
            held = [(own, fp & 0xFFFFFFFFFFFFFFFF) for _, own, fp in unit]
            tree = BKTree([fp for own, fp in held if own == p])
            links = list(_spanning(tree, [fp for own, fp in held if own == q], radius))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(side, np.uint64).view(np.int64)) for side in zip(*links, strict=True)], ["a", "b"])

    ordered = units.select("mask", "key", "p", "q", "part", "fp").repartition("mask", "key", "p", "q").sortWithinPartitions("mask", "key", "p", "q")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, text_key, fp, component_id), a row for each row of docs."""
    marked = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(fingerprint_links(nodes.select("fp"), radius))
    classes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # Written down, so that a large class meets its id in a join of two plain shuffles, which Spark can split.
    least = durable(classes.groupBy("label").agg(F.min("least").alias("component_id")))
    of_fp = classes.select("fp", "label").join(least, "label").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts: A-Z lower-cased, words split at ASCII white space, shingles of `shingle` words, repeats counted. Documents
    whose fingerprints differ in `radius` bits or fewer are linked. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows each keep their row; a null doc_id never is a component_id unless all its group's are
    null. An empty table gives no rows; other columns are ignored.
    """
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _grouped(docs, id_col, text_col, shingle, radius).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs without those that are near copies of a document with a smaller id.

    Columns stay as they are. A row is judged by its id and its text together, so of rows with one id and several texts
    each follows its own group; rows equal in both share their decision; a row without id stays only where its whole
    group has none. Null and empty texts are one group. An empty table gives no rows.
    """
    groups = _grouped(docs, id_col, text_col, shingle, radius)
    dropped = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__dropped"), F.col("text_key").alias("__key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__dropped")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__key"))
    return docs.join(dropped, same, "left_anti")
