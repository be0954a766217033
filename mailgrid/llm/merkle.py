"""A Merkle manifest of a table, with a witness for every row.

The rows of each group, in order, are the leaves of a tree in which every run of 16 neighbours has
one parent; the groups' roots are the leaves of a tree of the same kind. The trees are built by
streaming aligned append: leaves are dealt in aligned blocks of 4,096, and a task that reads a
block in order appends each leaf to the open runs, one per level. A leaf gets its partial witness
when its run is complete; whenever a run further up is complete, the witnesses of all leaves below
it are extended by the new siblings. The roots of the blocks are further appends: they are leaves
of the next round, which has 4,096 times fewer rows, and so on to the root. What a block root's own
witness says holds for all its leaves, so it is handed down once to each block and not stored with
the rows.

A group may hold any part of the rows: places in a group come from a range partitioning by (group,
order), of which only the sizes of the stretches are added up.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailgrid.llm.common import fresh, reachable
from mailgrid.session import checkpointed

FANOUT = 16
# Levels of a block, and its leaves.
DEPTH = 3
BLOCK = FANOUT**DEPTH
# Rows of a batch of witnesses.
ROWS = 1024

STEPS = "array<struct<left: string, right: string>>"


def field(column):
    """A value as part of a leaf: `-` for NULL, else its UTF-8 length, a colon and itself."""
    value = column.cast("string")
    length = F.octet_length(value).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns):
    """Lower-case hex sha256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def siblings(witness):
    """The digests of a witness, level by level, left to right, as one string."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf, witness):
    """The root that a leaf and its witness lead to."""
    step = lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256)
    return F.aggregate(witness, leaf, step)


def node(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class OpenRuns:
    """The open runs of one block while its leaves are appended, one run for each level."""

    def __init__(self, depth):
        self.depth = depth
        self.runs = [[] for _ in range(depth + 1)]
        self.witnesses = []

    def append(self, digest):
        witness = []
        self.witnesses.append(witness)
        self.add(0, digest, [witness])

    def add(self, level, digest, below):
        run = self.runs[level]
        run.append((digest, below))
        if level < self.depth and len(run) == FANOUT:
            self.complete(level)

    def complete(self, level):
        """Extends the witnesses below a run by their siblings and appends its parent."""
        run, self.runs[level] = self.runs[level], []
        digests = [digest for digest, _ in run]
        for i, (_, below) in enumerate(run):
            step = "".join(digests[:i]), "".join(digests[i + 1 :])
            for witness in below:
                witness.append(step)
        self.add(level + 1, node(digests), [w for _, below in run for w in below])

    def root(self):
        """Completes the last run of every level, however short, and gives the block's root."""
        for level in range(self.depth):
            if self.runs[level]:
                self.complete(level)
        return self.runs[self.depth][0][0]


def depth_of(leaves):
    """Levels above the leaves of a block of a tree with that many leaves."""
    depth = 0
    while depth < DEPTH and FANOUT**depth < leaves:
        depth += 1
    return depth


def streamed_blocks(batches, first):
    """Arrow tables of the blocks of an ordered stream; the column ``first`` marks their first
    rows. A block may cross batches."""
    held = []
    for batch in batches:
        at = 0
        for cut in np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False)).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        if batch.num_rows > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(nodes):
    return nodes.withColumn("_block", F.expr(f"_at div {BLOCK}"))


def dealt(rows):
    """Brings each block together in one task, in order."""
    return rows.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_at")


def parents(nodes):
    """The roots of the blocks as nodes of the next round."""

    def run(batches):
        out = []
        for block in streamed_blocks(batches, "_first"):
            leaves = block.column("_n")[0].as_py()
            runs = OpenRuns(depth_of(leaves))
            for digest in block.column("_digest").to_pylist():
                runs.append(digest)
            place = block.column("_block")[0].as_py()
            out.append((block.column("_group")[0].as_py(), place, runs.root(), -(-leaves // BLOCK)))
            if len(out) == ROWS:
                yield as_nodes(out)
                out = []
        if out:
            yield as_nodes(out)

    def as_nodes(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_group", "_at", "_digest", "_n"]
        )

    slim = in_blocks(nodes.select("_group", "_at", "_digest", "_n"))
    ordered = dealt(slim.withColumn("_first", F.col("_at") % BLOCK == 0))
    return ordered.mapInArrow(run, "_group string, _at long, _digest string, _n long")


def witnessed(nodes, above):
    """Adds ``_witness`` and ``_subroot`` to the nodes; ``above`` has one row with the witness
    and the subroot of each block's root."""
    carried = [c for c in nodes.columns if c not in ("_group", "_at", "_digest", "_n")]
    fixed = ["_group", "_at", "_digest", "_n"]
    schema = nodes.select(*fixed, *carried).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches):
        for block in streamed_blocks(batches, "_first"):
            known = block.column("_witness")[0].as_py()
            upper = [(s["left"], s["right"]) for s in known]
            subroot = block.column("_subroot")[0].as_py()
            rows = block.slice(1).select([*fixed, *carried])
            runs = OpenRuns(depth_of(rows.column("_n")[0].as_py()))
            for digest in rows.column("_digest").to_pylist():
                runs.append(digest)
            runs.root()
            for at in range(0, rows.num_rows, ROWS):
                part = rows.slice(at, ROWS).combine_chunks()
                steps = [w + upper for w in runs.witnesses[at : at + ROWS]]
                ends = [0]
                for s in steps:
                    ends.append(ends[-1] + len(s))
                halves = [pa.array([s[k] for w in steps for s in w], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
                          for c in part.columns],
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()),
                            pa.StructArray.from_arrays(halves, ["left", "right"]),
                        ),
                        pa.array([subroot] * part.num_rows, pa.string()),
                    ],
                    [*fixed, *carried, "_witness", "_subroot"],
                )

    below = in_blocks(nodes).withColumn("_first", F.lit(False))
    heads = above.select(
        "_group", F.col("_at").alias("_block"), F.lit(-1).cast("long").alias("_at"),
        F.lit(True).alias("_first"), "_witness", "_subroot",
    )
    stream = dealt(below.unionByName(heads, allowMissingColumns=True))
    return stream.mapInArrow(run, f"{ddl}, _witness {STEPS}, _subroot string")


def placed(rows, order):
    """Adds ``_at``, the place in the ``_group`` from 0 on, and ``_n``, the group's size."""
    by = [F.col("_group").asc_nulls_first(), *order]
    numbered = checkpointed(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id())
        # The number's upper bits are the partition.
        .withColumn("_part", F.shiftright("_row", 33))
    )
    stretches = numbered.groupBy("_group", "_part").agg(
        F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_rows")
    )
    # A group has one row here for each partition it touches.
    group = Window.partitionBy("_group")
    sizes = stretches.select(
        F.col("_group").alias("_g"),
        F.col("_part").alias("_p"),
        "_from",
        (F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(group).alias("_n"),
    )
    same = (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g"))
    return (
        numbered.join(sizes, same)
        .withColumn("_at", F.col("_row") - F.col("_from") + F.col("_before"))
        .drop("_row", "_part", "_g", "_p", "_from", "_before")
    )


def rounds(leaves):
    """The nodes of every round, the leaves first, up to one node for each group."""
    found = [leaves]
    while not found[-1].filter("_n > 1").isEmpty():
        found.append(checkpointed(parents(found[-1])))
    return found


def hand_down(levels, top):
    """The leaves with their witnesses, from the witnesses of the last round's nodes."""
    for nodes in reversed(levels[:-1]):
        top = witnessed(nodes, top)
    return top


def manifest(docs, columns, key="doc_id", group="source", keep=None):
    """One row per row of the table: the key, leaf, subroot, root, witness (array of the digests
    left and right of the node at each level), and the columns of ``keep``, a dictionary of
    further columns by name.

    A leaf is the digest of ``columns``. Leaves ascend by key within their group, NULL keys
    first; rows with equal keys ascend by leaf, so repeated rows are interchangeable. NULL is a
    group of its own, the first one; groups are ordered by their UTF-8 bytes. A lone leaf is its
    group's subroot and a lone subroot is the root; its witness has no step there. An empty table
    has no root and no rows.
    """
    reachable(docs.sparkSession)
    keep = keep or {}
    own = {n: fresh(docs, f"_c{i}") for i, n in enumerate(keep)}
    rows = checkpointed(
        docs.select(
            F.col(group).cast("string").alias("_group"),
            F.col(key).alias("_key"),
            leaf_digest(*map(F.col, columns)).alias("_digest"),
            *[c.alias(own[n]) for n, c in keep.items()],
        )
    )
    order = [F.col("_key").asc_nulls_first(), F.col("_digest")]
    levels = rounds(checkpointed(placed(rows, order)))
    subroots = levels[-1].select(
        F.lit("").alias("_group"), F.col("_group").alias("_of"), "_digest"
    )
    tree = rounds(checkpointed(placed(subroots, [F.col("_of").asc_nulls_first()])))
    # One row.
    root = tree[-1].select("_digest").first()
    nothing = F.array().cast(STEPS)
    top = tree[-1].withColumns({"_witness": nothing, "_subroot": F.lit("")})
    of_groups = hand_down(tree, top).select(
        F.col("_of").alias("_group"), F.lit(0).cast("long").alias("_at"), "_digest", "_witness",
        F.col("_digest").alias("_subroot"),
    )
    if len(levels) == 1:
        # Every group is one leaf.
        carried = levels[0].alias("l").join(
            of_groups.alias("g"), F.col("l._group").eqNullSafe(F.col("g._group"))
        ).select("l.*", "g._witness", "g._subroot")
    else:
        carried = hand_down(levels, of_groups)
    return carried.select(
        F.col("_key").alias(key),
        F.col("_digest").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.lit(root[0] if root else None).cast("string").alias("root"),
        F.col("_witness").alias("witness"),
        *[F.col(own[n]).alias(n) for n in keep],
    )


def audit(docs, key="doc_id", text="text", group="source"):
    """One row per document: key, leaf, subroot, root, proof_sha256 of its witness' digests,
    folded_root and verified (it equals the root).

    Where 5 divides the crc32 of the key, the row is tampered with before it is checked: A-Z of
    its text become lower-case. NULL keys are not tampered with.
    """
    fields = [key, group, "lang", "n_chars", text]
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    tampered = leaf_digest(*[lower if c == text else F.col(c) for c in fields])
    rows = manifest(docs, fields, key, group, {"tampered": F.when(changed, tampered)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("witness"))
    return rows.select(
        key, "leaf", "subroot", "root", F.sha2(siblings("witness"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
