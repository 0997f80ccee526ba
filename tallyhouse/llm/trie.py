"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Turns get their place by a range partitioning over (conversation, turn), so a
conversation of any length is spread over tasks. A prefix is known by two
64-bit numbers: the exclusive or, over its turns, of two hashes of the turn's
SHA-256 and its place. That is a running sum within a range partition, plus one
row for each partition that a conversation runs through; a node's parent is the
node's number with its last turn taken out again.

Subtree totals come from tree contraction in join rounds (``subtree_sums``):
leaves are raked into their parents, unary nodes are compressed out of their
chains, and the contracted nodes are expanded again in the reverse order. The
rounds grow with the logarithm of the tree, however deep or wide it is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_stream, shared_dir, stored

GROUP = 100     # a conversation starts with turns of the first one of its hundred
SHARED = 6      # shared turns: crc32(conv_id) % SHARED, so SHARED - 1 at most
PIECE = 8192    # ids of a run that is written out as one string
ACTIVE, RAKED, COMPRESSED = 0, 1, 2
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _xor(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): what is needed of a turn; the digest is
    the SHA-256 of role and text, kept apart by the role's length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.sha2(spelled, 256).alias("digest"), F.length(text).cast("long").alias("chars")))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in the order (turn, digest), nulls first: (conv_id, part, at,
    digest, chars) with a running number in the partition, and for each
    conversation and partition (conv_id, part, start, before, length): the first
    number, the turns in earlier partitions, and those of the conversation.
    Written out, as a range partitioning may deal rows otherwise a second time."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "digest", "chars"))
    ranged = stored(ranged)
    runs = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id").orderBy("part")
    runs = runs.select("conv_id", "part", "start", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                       F.sum("n").over(Window.partitionBy("conv_id")).alias("length"))
    return ranged, runs


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, depth, n1, n2, p1, p2, chars, last)
    for each turn, with the numbers of its prefix and of the prefix before it;
    and (conv_id, turns) for each conversation."""
    ranged, runs = placed(turns(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    runs = stored(runs.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % GROUP}))
    lengths = runs.where("before = 0 and conv_id = base").select("base", F.col("length").alias("base_length"))
    runs = runs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_length", F.lit(0)))).drop("base_length")
    runs = runs.withColumn("turns", F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))

    place = F.col("at") - F.col("start") + F.col("before") + 1
    depth = F.when(F.col("conv_id") == F.col("base"), F.col("pos")).otherwise(F.col("k") + F.col("pos") - F.col("h"))
    rows = ranged.join(runs, ["conv_id", "part"]).withColumn("pos", place).withColumn("depth", depth)
    rows = rows.withColumns({"f1": F.xxhash64("digest", "depth", F.lit(1)), "f2": F.xxhash64("digest", "depth", F.lit(2)), "own": F.col("pos") > F.col("h")})
    rows = rows.where((F.col("own")) | ((F.col("conv_id") == F.col("base")) & (F.col("pos") < SHARED)))
    running = Window.partitionBy("conv_id", "part").orderBy("pos")
    rows = rows.withColumns({f"c{i}": F.bit_xor(F.when(F.col("own"), F.col(f"f{i}"))).over(running) for i in (1, 2)})
    rows = stored(rows.select("conv_id", "part", "base", "pos", "k", "depth", "f1", "f2", "c1", "c2", "chars", "own", "turns"))

    few = Window.partitionBy("conv_id").orderBy("pos")  # SHARED - 1 rows at most
    firsts = (rows.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < SHARED))
              .select("base", "pos", "f1", "f2", "chars", *[F.bit_xor(f"f{i}").over(few).alias(f"g{i}") for i in (1, 2)]))
    convs = runs.where("before = 0").select("conv_id", "base", "h", "k", "turns")
    head = convs.join(firsts, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), F.col("g1").alias("n1"), F.col("g2").alias("n2"), "f1", "f2", "chars", "turns")

    parts = rows.where("own").groupBy("conv_id", "part").agg(*[F.bit_xor(f"f{i}").alias(f"t{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *[F.bit_xor(f"t{i}").over(earlier).alias(f"o{i}") for i in (1, 2)]).where("o1 is not null")
    start = firsts.select("base", F.col("pos").alias("k"), "g1", "g2")
    tail = rows.where("own").join(parts, ["conv_id", "part"], "left").join(start, ["base", "k"], "left").select(
        "conv_id", "depth", *[_xor(_xor(f"c{i}", f"o{i}"), f"g{i}").alias(f"n{i}") for i in (1, 2)], "f1", "f2", "chars", "turns")
    every = head.unionByName(tail).select("conv_id", "depth", "n1", "n2", _xor("n1", "f1").alias("p1"), _xor("n2", "f2").alias("p2"), "chars",
                                          (F.col("depth") == F.col("turns")).alias("last"))
    return stored(every), convs.select("conv_id", "turns")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (n1, n2, conv_id) as (n1, n2, first, ids): the ids of a run
    of rows of one node, comma-joined, PIECE of them at most."""
    for b in batches:
        n1, n2, ids = (b.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1
        starts = np.unique(np.concatenate([[0], new, np.arange(0, len(ids), PIECE)])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(ids))
        spelled = [str(i) for i in ids.tolist()]
        yield pa.RecordBatch.from_pydict({"n1": n1[starts], "n2": n2[starts], "first": ids[starts],
                                          "ids": pa.array([",".join(spelled[a:z]) for a, z in zip(starts, ends, strict=False)], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (n1, n2, first, ids) as (n1, n2, ends_sha256): the runs of a
    node pass through one after another and are not kept."""
    node, sha, out = None, None, []

    def batch() -> pa.RecordBatch:
        n1, n2, digest = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"n1": pa.array(n1, pa.int64()), "n2": pa.array(n2, pa.int64()), "ends_sha256": pa.array(digest, pa.string())})

    for b in batches:
        for n1, n2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if node == (n1, n2):
                sha.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, sha.hexdigest()))
            node, sha = (n1, n2), hashlib.sha256(ids.encode())
            if len(out) >= PIECE:
                yield batch()
                out.clear()
    if node:
        out.append((*node, sha.hexdigest()))
    yield batch()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of rows (n1, n2, conv_id): SHA-256 of a node's ids
    in ascending order, comma-joined. Ids are sorted and spelled over range
    partitions, so those of a large node by many tasks; only its finished
    strings, one for PIECE ids, pass one after another through the one task that
    the sequential digest needs."""
    order = ["n1", "n2", "conv_id"]
    runs = map_stream(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _runs, "n1 bigint, n2 bigint, first bigint, ids string")
    return map_stream(runs.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first"), _digests, "n1 bigint, n2 bigint, ends_sha256 string")


def _write(df: DataFrame) -> str:
    path = f"{shared_dir(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _round(active: DataFrame, number: int) -> DataFrame:
    """One rake and one compress step over the active nodes.

    A node holds its own weights and those raked into it in (w1, w2); what an
    edge to its parent stands for besides in (e1, e2); a node without active
    children has kids = 0. One grouping by node brings each its children: the
    raked ones as sums, of the others their number and, where it is one, which
    it is. A unary node leaves its chain if its priority is below its child's and
    its parent's, so no two neighbours leave at once; its child takes over its
    parent and its weights. Priorities are the lowest set bit of the depth, by
    which chains halve, then a hash; a root, at depth 0, never leaves."""
    node = ["c", "d", "pc", "pd", "w1", "w2", "e1", "e2", "kids"]
    none = F.lit(None).cast("long")
    own = active.select(*node, *[none.alias(x) for x in ("r1", "r2", "kc", "kd", "k1", "k2")], F.lit(0).cast("long").alias("alive"))
    raked, stays = F.col("kids") == 0, F.col("kids") > 0
    up = active.where("pc is not null").select(
        F.col("pc").alias("c"), F.col("pd").alias("d"), *[none.alias(x) for x in node[2:]],
        *[F.when(raked, F.col(f"w{i}") + F.col(f"e{i}")).alias(f"r{i}") for i in (1, 2)],
        *[F.when(stays, F.col(x)).alias(y) for x, y in (("c", "kc"), ("d", "kd"), ("e1", "k1"), ("e2", "k2"))], stays.cast("long").alias("alive"))
    both = own.unionByName(up).groupBy("c", "d").agg(
        *[F.max(x).alias(x) for x in ("pc", "pd", "w1", "w2", "e1", "e2", "kc", "kd", "k1", "k2")], F.max("kids").alias("before"),
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in (1, 2)], F.sum("alive").alias("kids"))

    def priority(c: str, d: str) -> Column:
        low = F.col(d).bitwiseAND(-F.col(d))
        return F.struct(low, F.xxhash64(c, d, F.lit(number)))

    leaves = (F.col("kids") == 1) & F.col("pc").isNotNull() & (priority("c", "d") < priority("kc", "kd")) & (
        (F.col("pd") == 0) | (priority("c", "d") < priority("pc", "pd")))
    moved = both.withColumn("state", F.when(F.col("before") == 0, F.lit(RAKED)).when(leaves, F.lit(COMPRESSED)).otherwise(F.lit(ACTIVE)))
    moved = moved.withColumns({f"w{i}": F.col(f"w{i}") + F.col(f"r{i}") for i in (1, 2)}).drop("before", "r1", "r2")
    handed = moved.where(F.col("state") == COMPRESSED).select(
        F.col("kc").alias("c"), F.col("kd").alias("d"), F.col("pc").alias("hc"), F.col("pd").alias("hd"),
        *[(F.col(f"w{i}") + F.col(f"e{i}")).alias(f"h{i}") for i in (1, 2)])
    return moved.join(handed, ["c", "d"], "left").select(
        "c", "d", F.coalesce("hc", "pc").alias("pc"), F.coalesce("hd", "pd").alias("pd"), "w1", "w2",
        *[(F.col(f"e{i}") + F.coalesce(f"h{i}", F.lit(0))).alias(f"e{i}") for i in (1, 2)], "kids", "kc", "kd", "k1", "k2", "state")


def subtree_sums(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """(c, d, t1, t2): for every node of a forest the sums of two weights over
    its subtree, itself included.

    ``tree`` is (c, d, pc, pd, w1, w2, kids): a node (any pair of bigints, d
    its depth), its parent (null for a root), weights and number of children.
    Each round is written to the shared folder, so a lost executor costs one
    round. Expansion goes through the rounds backwards: the total of a node
    compressed in a round is that of its child then, which left later."""
    active = tree.select("c", "d", "pc", "pd", "w1", "w2", F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"), "kids")
    paths, schema = [], None
    while True:
        step = _round(active, len(paths))
        schema = step.schema
        paths.append(_write(step))
        active = spark.read.schema(schema).parquet(paths[-1]).where(F.col("state") == ACTIVE).drop("state", "kc", "kd", "k1", "k2")
        if active.isEmpty():
            break

    def rounds(which: list[str], state: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*which).where(F.col("state") == state)

    def raked(which: list[str]) -> DataFrame:
        return rounds(which, RAKED).select("c", "d", F.col("w1").alias("t1"), F.col("w2").alias("t2"))

    found: list[str] = []
    for i in range(len(paths) - 2, -1, -1):
        left = rounds([paths[i]], COMPRESSED)
        later = raked(paths[i + 1:])
        if found:
            later = later.unionByName(spark.read.schema(later.schema).parquet(*found))
        later = later.select(F.col("c").alias("kc"), F.col("d").alias("kd"), "t1", "t2")
        found.append(_write(left.join(later, ["kc", "kd"]).select(
            "c", "d", *[(F.col(f"t{k}") + F.col(f"k{k}") + F.col(f"w{k}")).alias(f"t{k}") for k in (1, 2)])))
    totals = raked(paths)
    return totals.unionByName(spark.read.schema(totals.schema).parquet(*found)) if found else totals


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): the trie of the rebuilt conversations, one row
    for each node; a node is the first ``depth`` turns of ``conv_id``, its
    smallest member.

    Turns are ordered by turn (null first), equal ones by the SHA-256 of role
    and text; rows that repeat are turns of their own. A null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out; an
    empty table has no node. Extra columns are not read. Two prefixes are taken
    for one if two 64-bit hashes of theirs agree."""
    spark = conversations.sparkSession
    rows, convs = rebuilt(conversations)
    found = rows.groupBy("n1", "n2").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                         F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("n1"), zero.alias("n2"), "conv_id", zero.alias("depth"), null.alias("p1"), null.alias("p2"), "n_convs", zero.alias("chars"))
    found = stored(found.unionByName(root))
    kids = found.where("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    above = found.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tree = stored(found.join(kids, ["n1", "n2"], "left").join(above, ["p1", "p2"], "left").select(
        "n1", "n2", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    sums = subtree_sums(spark, tree.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"),
        (F.col("n_children") == 0).cast("long").alias("w1"), F.col("saved").alias("w2"), F.col("n_children").alias("kids")))
    ends = rows.where("last").select("n1", "n2", "conv_id").unionByName(convs.where("turns = 0").select(zero.alias("n1"), zero.alias("n2"), "conv_id"))
    return (tree.join(sums.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("t1").alias("n_leaves"), F.col("t2").alias("saved_tokens")), ["conv_id", "depth"])
            .join(ends_digests(ends), ["n1", "n2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")))
