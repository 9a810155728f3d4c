"""A Merkle manifest of a dataset: a tree over the rows of each group, one over the groups' roots, and a proof for every row.

Order. A narrow table (group, id, digests) is sorted by range of (group, id, digest), so a group of any size lies in several partitions; a row's place in its
group is its place in the partition plus what the partitions before hold of the group. Texts are hashed where they are read and never shuffled.

Trees. Every group is cut into aligned blocks of ``fanout ** levels`` leaves, the partitions of the exchange. A block hashes its own subtree. Then the
blocks of a group exchange roots as a butterfly: in round r, block b gets, from each other of the ``fanout`` aligned subtrees of ``fanout ** r`` blocks that
meet under its next ancestor, the subtree's root from the one member that stands where b stands in its own (where the last subtree is short, places are counted
around). Every block hashes that ancestor itself, as all its neighbours do, and notes the others' roots as the next step of its proof. After
``log(blocks)`` rounds each block holds the group's root and all upper proof steps; nothing has to be passed down again. The groups' roots are the leaves of a last tree,
made by the same steps.

Hash. H is the SHA-256 of its inputs, one after another, as lower-case hex text. A leaf is H of the columns, each ``-`` for a null, else byte
count, colon, value. A run of ``fanout`` consecutive nodes (the last may be shorter, even one) becomes their H while a level has several.

Null groups are one group, the first; groups follow by bytes. Null ids come first in their group; rows that share an id are ordered by their leaf. An empty
table has no rows and no root. Columns that are not named are neither hashed nor read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlog.llm.packed import grouped
from decisionlog.llm.shared import partitions, stored

FANOUT, LEVELS = 3, 7
#: columns of a leaf and the order they are hashed in
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*values: Column) -> Column:
    """H of values as they stand, each told apart by its length."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def parents(nodes: list[str], fanout: int) -> list[str]:
    return [_h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def subtree(leaves: list[str], fanout: int, levels: int, size: int) -> tuple[str, list[list[str]]]:
    """The root over a block's leaves, and the nodes of each level below it: one of several blocks goes through all its levels, a tree of
    ``size`` leaves that fits one block ends where one node is left."""
    held, nodes, whole = [], leaves, size <= fanout**levels
    while len(nodes) > 1 if whole else len(held) < levels:
        held.append(nodes)
        nodes = parents(nodes, fanout)
    return nodes[0], held


def steps_of(held: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    """The run mates of a leaf's ancestors, left and right of them."""
    out = []
    for nodes in held:
        a = place - place % fanout
        out.append(("".join(nodes[a:place]), "".join(nodes[place + 1 : a + fanout])))
        place //= fanout
    return out


def placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with their place in their tree and its size, however large a tree is."""
    by = [F.col("tree").asc_nulls_first(), *order]
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields]
    numbered = stored(ranged.mapInArrow(_numbered, ", ".join([*columns, "place long"])))
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), before.alias("before"), F.sum("n").over(tree).alias("size"))
    known = F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return numbered.join(counts, known).withColumn("place", F.col("place") + F.col("before")).drop("t", "p", "before", "part")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree with their place in it, as far as this partition goes."""
    last, count = None, 0
    for batch in batches:
        if not len(batch):
            continue
        codes = batch.column("tree").dictionary_encode()
        number = np.asarray(codes.indices.fill_null(-1).cast(pa.int64()))
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        place = np.arange(len(batch)) - np.repeat(first, np.diff(np.r_[first, len(batch)]))
        tree = (batch.column("tree")[0].as_py(),)
        if tree == last:
            place[: first[1] if len(first) > 1 else len(batch)] += count
        last, count = (batch.column("tree")[len(batch) - 1].as_py(),), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


#: a block: its leaves in order, and what belongs to them
BLOCK = "tree string, block long, size long, root string, ids array<string>, leaves array<string>, others array<string>"


def packed_blocks(fanout: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block, one after another in their order, as one row with the block's root."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(_labelled(batches)):
            leaves = rows.column("leaf").to_pylist()
            root, _ = subtree(leaves, fanout, levels, rows.column("size")[0].as_py())
            values = [rows.column(c)[0].as_py() for c in ("tree", "block", "size")] + [root, rows.column("id").to_pylist(), leaves, rows.column("other").to_pylist()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.string())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _names(BLOCK))

    return pack


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a first column that changes where a block ends."""
    for batch in batches:
        labels = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([repr(x) for x in labels], pa.string()), *batch.columns], ["label", *batch.schema.names])


def exchanged(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks (tree, block, size, root) with the root of their tree and the steps from their own root up to it."""
    width = fanout**levels
    now = blocks.select("tree", "block", F.ceil(F.col("size") / width).alias("blocks"), "root", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("steps"))
    most = now.agg(F.max("blocks")).first()[0] or 1
    reach = 1
    while reach < most:  # a round: subtrees of ``reach`` blocks meet under an ancestor
        own, place = F.floor(F.col("block") / reach), F.col("block") % reach
        seats = F.sequence(own - own % fanout, own - own % fanout + fanout - 1)
        mates = F.filter(seats, lambda s: (s != own) & (s * reach < F.col("blocks")))
        # the member of each mate's subtree that sends: at this block's place, counted around where the subtree is short
        asked = F.transform(mates, lambda s: F.struct(s.alias("seat"), (s * reach + place % F.least(F.lit(reach), F.col("blocks") - s * reach)).alias("sender")))
        wants = now.filter(F.col("blocks") > reach).select("tree", "block", own.alias("own"), F.explode_outer(asked).alias("ask"))
        sent = now.select(F.col("tree").alias("from_tree"), F.col("block").alias("from_block"), F.col("root").alias("got"))
        met = wants.join(sent, F.col("tree").eqNullSafe(F.col("from_tree")) & (F.col("ask.sender") == F.col("from_block")), "left")
        side = lambda where: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("ask.seat", "got")))), lambda x: x["got"]))
        gained = met.groupBy(F.col("tree").alias("t"), F.col("block").alias("b")).agg(
            side(F.col("ask.seat") < F.col("own")).alias("left"), side(F.col("ask.seat") > F.col("own")).alias("right")
        )
        known = F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))
        more = F.array(F.struct("left", "right"))
        now = stored(
            now.join(gained, known, "left").select(
                "tree",
                "block",
                "blocks",
                F.when(F.col("b").isNull(), F.col("root")).otherwise(F.sha2(F.concat("left", "root", "right"), 256)).alias("root"),
                F.when(F.col("b").isNull(), F.col("steps")).otherwise(F.concat("steps", more)).alias("steps"),
            )
        )
        reach *= fanout
    return now


def forest(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, id, key, leaf, other), ordered by key, as packed blocks, and per block its tree's root and the steps up to it."""
    order = [F.col("key").asc_nulls_first(), F.col("leaf").asc(), F.col("other").asc()]
    cut = placed(nodes, order).withColumn("block", F.floor(F.col("place") / fanout**levels))
    rows = cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").select("tree", "block", "size", "id", "leaf", "other")
    blocks = stored(rows.mapInArrow(packed_blocks(fanout, levels), BLOCK))
    return blocks, exchanged(blocks.select("tree", "block", "size", "root"), fanout, levels)


def _above(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """Blocks with their tree's root and steps."""
    tops = tops.select(F.col("tree").alias("t"), F.col("block").alias("b"), F.col("root").alias("subroot"), "steps")
    return blocks.join(tops, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b", "root")


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its steps give."""
    for left, right in steps:
        leaf = _h(left + leaf + right)
    return leaf


def _pairs(steps: list[dict]) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in steps]


TOPS = "name string, root string, top array<struct<left:string,right:string>>"
PROOFS = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def leaf_steps(fanout: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the last tree as one row per leaf with all its steps."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            _, held = subtree(row["leaves"], fanout, levels, row["size"])
            found = [steps_of(held, k, fanout) + _pairs(row["steps"]) for k in range(len(row["leaves"]))]
            found = [[{"left": a, "right": b} for a, b in x] for x in found]
            columns = [pa.array(row["ids"], pa.string()), pa.array([row["subroot"]] * len(found), pa.string()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, _names(TOPS)[:3])

    return steps


def proofs(fanout: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the steps above them as one row per leaf, its proof folded again from what is held now."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            _, held = subtree(row["leaves"], fanout, levels, row["size"])
            above = _pairs(row["steps"]) + _pairs(row["top"])
            tail, digests, again = "".join(a + b for a, b in above), [], []
            for place, other in enumerate(row["others"]):
                steps = steps_of(held, place, fanout)
                digests.append(_h("".join(a + b for a, b in steps) + tail))
                again.append(folded(other, steps + above))
            n, root = len(again), row["root"]
            texts = [row["ids"], row["leaves"], [row["subroot"]] * n, [root] * n, digests, again]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in texts), pa.array([x == root for x in again])], _names(PROOFS))

    return prove


def manifest(
    rows: DataFrame, leaf: Column, other: Column, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """Per row its id (as text), leaf, the roots, the digest of its proof, and the root that ``other`` gives with the row's proof.

    ``leaf`` is the digest that the trees are made of; ``other`` the digest of the row as somebody holds it now; ``verified`` tells whether that leads to
    the root.
    """
    key = F.col(id_col)
    blocks, tops = forest(rows.select(F.col(group_col).cast("string").alias("tree"), key.cast("string").alias("id"), key.alias("key"), leaf.alias("leaf"), other.alias("other")), fanout, levels)
    name = F.col("tree")
    last = tops.filter("block = 0").select(F.lit("").alias("tree"), name.alias("id"), name.alias("key"), F.col("root").alias("leaf"), F.col("root").alias("other"))
    top = _above(*forest(last, fanout, levels)).mapInArrow(leaf_steps(fanout, levels), TOPS)
    return _above(blocks, tops).join(top, F.col("tree").eqNullSafe(F.col("name"))).drop("name").mapInArrow(proofs(fanout, levels), PROOFS)


def leaf_of(text: Column | None = None) -> Column:
    """H of the columns of a document, with ``text`` in place of its own."""
    return hashed(*(text if c == "text" and text is not None else F.col(c) for c in LEAF))


def verify(docs: DataFrame, tampered: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, checked against rows that hold the text ``tampered``."""
    found = manifest(docs, leaf_of(), leaf_of(tampered), "doc_id", "source", fanout, levels)
    return found.withColumnRenamed("id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint"))
