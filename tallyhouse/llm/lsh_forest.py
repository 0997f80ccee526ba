"""N-gram Jaccard join: a MinHash LSH forest and exact verification.

A document is the set of its five-word shingles. Documents with equal sets are
copies and stand for each other. A set has a label of DEPTH MinHash values in
each of TREES trees. The trees are sorted tries: all labels of a tree in order,
so that the sets below any prefix stand side by side, and the prefix that two
neighbours share says at which levels of the trie they meet. The join starts at
the full depth and shortens the prefix, level by level, until the recall reaches
the target: that of the links measured on a sample, and for pairs at the
threshold the one that follows from the number of trees (``chosen_level``).
Neighbours that share the prefix are linked, not every two sets below it, so
that candidates form groups.

Every two sets of a group are then compared exactly, on shingle counts. Groups
are verified where they lie together; one with more than BLOCK sets is dealt
out as blocks of like sizes (sets that differ by more than the threshold in
size cannot match), a task for each two blocks. Tasks return counts and a tree
of links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_stream, stored, texts
from .graph import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, RECALL = 64, 8, 1 - 1e-10
VALUE = 2              # bytes of a MinHash value in a label
LABEL = 1 + DEPTH * VALUE  # bytes of a tree's number and label
SAMPLE = 128           # documents whose links are looked for exactly, to measure the recall of each level
SAMPLE_CHARS = 200_000  # a longer text is not drawn for the sample
BLOCK = 512   # sets that one task compares with each other, or with as many
ALL = 2       # part of a set that its task compares with all others
UNIVERSE = 8192  # shingles of a block of the overlap product

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = _rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall_at(level: int, threshold: float = THRESHOLD) -> float:
    """The share of pairs at the threshold that meet at a level in some tree."""
    return 1 - (1 - threshold**level) ** TREES


def shingles(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles, ascending. Words are
    the pieces between ASCII white space with A-Z lowered; one to four words
    are one shingle, no word is none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    x = sum(h[i : n - WORDS + 1 + i] * _PLACE[i] for i in range(WORDS))
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def label_matrix(s: np.ndarray) -> np.ndarray:
    """TREES rows of LABEL bytes: the tree's number and its MinHash values."""
    least = np.concatenate([(s[None, :] * _HASH[i : i + 16, None]).min(1) for i in range(0, len(_HASH), 16)])
    least ^= least >> np.uint64(31)
    least *= np.uint64(0x9E3779B97F4A7C15)
    values = (least >> np.uint64(64 - 8 * VALUE)).astype(f">u{VALUE}").reshape(TREES, DEPTH)
    return np.concatenate([np.arange(TREES, dtype=np.uint8)[:, None], values.view(np.uint8).reshape(TREES, DEPTH * VALUE)], axis=1)


def shared_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each two rows of label matrices share from the start."""
    same = (a == b)[:, 1:].reshape(len(a), DEPTH, VALUE).all(2)
    return np.where((a[:, 0] == b[:, 0]), np.cumprod(same, axis=1).sum(1), 0)


class Sample:
    """Sets whose links are found exactly, and at which level they meet."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.sets = [s for s in sets if len(s)]
        self.threshold = threshold
        self.labels = [label_matrix(s) for s in self.sets]
        flat = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.sizes = flat[order], owner[order], np.array([len(s) for s in self.sets], np.int64)

    def levels(self, s: np.ndarray, labels: np.ndarray) -> list[int]:
        """The deepest level at which the set meets each sampled one that it is
        linked to, and is not equal to."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        owners = np.concatenate([self.owner[lo[i] : hi[i]] for i in hit])
        both = np.bincount(owners, minlength=len(self.sets))
        union = self.sizes + len(s) - both
        linked = np.flatnonzero((both >= self.threshold * union - 1e-9) & (both < union))
        return [int(shared_levels(labels, self.labels[i]).max()) for i in linked]


def draw(docs: DataFrame, threshold: float = THRESHOLD) -> Sample:
    """SAMPLE documents, those of the least hashes of their id, less the longer
    ones. Ids are drawn first, so that a task sends SAMPLE ids to the driver and
    no texts; then their texts, of SAMPLE_CHARS code points at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    ids = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7))).limit(SAMPLE).collect()]
    drawn = rows.where(F.col("doc_id").isin(ids) & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE)
    return Sample([shingles(r["text"].encode("utf-8", "surrogatepass")) for r in drawn.collect()], threshold)


def signatures(docs: DataFrame, sample: Sample) -> DataFrame:
    """(doc_id, digest, n, labels, met) of every row with an id: digest of the
    shingle set, its size, its labels one after another (null without words),
    and the levels at which it meets the sampled sets it is linked to."""
    def sign(batch: pa.RecordBatch) -> dict:
        digest, size, labels, met = [], [], [], []
        for t in texts(batch):
            s = shingles(t)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            matrix = label_matrix(s) if len(s) else None
            labels.append(matrix.tobytes() if len(s) else None)
            met.append(sample.levels(s, matrix) if len(s) else [])
        return {"doc_id": batch.column(0), "digest": pa.array(digest, pa.binary()), "n": pa.array(size, pa.int64()),
                "labels": pa.array(labels, pa.binary()), "met": pa.array(met, pa.list_(pa.int32()))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return map_batches(rows, sign, "doc_id bigint, digest binary, n bigint, labels binary, met array<int>")


def chosen_level(counts: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The deepest level that reaches the target. From the full depth the prefix
    is shortened while the links of the sample (``counts``: how many meet at
    which level at the deepest) that meet there, or pairs at the threshold, fall
    short of the recall; 1 at least."""
    every = sum(counts.values())
    level = DEPTH
    while level > 1 and (sum(n for k, n in counts.items() if k >= level) < recall * every or recall_at(level, threshold) < recall):
        level -= 1
    return level


def trie_edges(labels: DataFrame, level: int) -> DataFrame:
    """(u, v): sets that stand side by side in a sorted trie and share ``level``
    values. ``labels`` is (doc_id, labels). The labels of all trees are sorted by
    a range partitioning, in which a prefix of many sets may run over several
    partitions; a partition's first and last label meet their neighbours in a
    table of two rows a partition."""
    head = 1 + level * VALUE

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), f"S{LABEL}")
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LABEL), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, pa.array(np.repeat(b.column(0).to_numpy(), TREES))], ["label", "rep"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            label = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, LABEL)
            rep = b.column(1).to_numpy()
            if last is not None:
                label, rep = np.concatenate([last[0], label]), np.concatenate([last[1], rep])
            else:
                first = (label[:1].copy(), rep[:1].copy())
            meet = (label[1:, :head] == label[:-1, :head]).all(1) & (rep[1:] != rep[:-1])
            yield rows(rep[1:][meet], rep[:-1][meet])
            last = (label[-1:].copy(), rep[-1:].copy())
        if first is not None:
            yield rows(first[1], None, first[0], False)
            yield rows(last[1], None, last[0], True)

    def rows(u, v, label=None, end=None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_pydict({
            "u": pa.array(u, pa.int64()), "v": pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()),
            "head": pa.nulls(n, pa.binary()) if label is None else pa.array([label[0, :head].tobytes()], pa.binary()),
            "end": pa.array([end] * n, pa.bool_())})

    spelled = map_stream(labels.select("doc_id", "labels"), spell, "label binary, rep bigint")
    ordered = spelled.repartitionByRange("label", "rep").sortWithinPartitions("label", "rep")
    walked = stored(map_stream(ordered, walk, "u bigint, v bigint, head binary, end boolean").withColumn("part", F.spark_partition_id()))
    ends = walked.where("head is not null")
    along = Window.orderBy("part", "end")  # two rows a partition
    across = ends.withColumns({"after": F.lead("head").over(along), "next": F.lead("u").over(along)}).where("end and head = after and u <> next")
    return walked.where("head is null").select("u", "v").unionByName(across.select("u", F.col("next").alias("v")))


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shared shingles of each of the first ``left`` sets with every set."""
    sizes = [len(s) for s in sets]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((left, len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, UNIVERSE):
        a, b = np.searchsorted(code, [start, start + UNIVERSE])
        held = np.zeros((len(sets), UNIVERSE), np.float32)
        held[owner[a:b], code[a:b] - start] = 1
        out += held[:left] @ held.T
    return out


def verified(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which of the first ``left`` sets match which sets, themselves left out;
    left = len(sets) compares all with each other."""
    n = np.array([len(s) for s in sets], np.float32)
    both = overlaps(sets, left)
    match = both >= threshold * (n[:left, None] + n[None, :] - both) - 1e-4
    match[np.arange(left), np.arange(left)] = False
    return match


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A task's rows: part 0 is compared with part 1, part ALL with itself,
        within each component. A rep's rows with another text are left out."""
        own = [xxhash.xxh3_128_digest(shingles(t.encode()).tobytes()) == bytes(d) for t, d in zip(rows["text"], rows["digest"], strict=True)]
        rows = rows[np.array(own, bool)]
        out = []
        for _, g in rows.groupby("component", sort=False):
            g = g.drop_duplicates("rep").sort_values(["part", "rep"])
            sets = [shingles(t.encode()) for t in g["text"]]
            rep, copies, part = (g[c].to_numpy() for c in ("rep", "copies", "part"))
            one = bool((part == ALL).any())
            left = len(g) if one else int((part == 0).sum())
            match = verified(sets, left, threshold)
            if not one:
                match[:, :left] = False  # two blocks: only across
            links = np.concatenate([match @ copies, np.zeros(len(g) - left, np.int64)])
            if not one:
                links[left:] = match[:, left:].T @ copies[:left]
            root = np.arange(len(g))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in range(left):
                for j in np.flatnonzero(match[i]):
                    a, b = top(i), top(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
            tops = np.array([top(i) for i in range(len(g))])
            out.append(pd.DataFrame({"rep": rep, "links": links.astype(np.int64), "root": rep[tops]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}, dtype=np.int64)
    return run


def tasks(groups: DataFrame, threshold: float) -> DataFrame:
    """(rep, digest, component, copies, task, part): where each set is compared. Sets of
    a group of up to BLOCK go to one task, which holds several such groups. A
    larger group is cut into bands of like sizes and hashed blocks of them;
    each two blocks of a band or of neighbouring bands are a task."""
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    rows = groups.join(size, "component")
    few = rows.where(F.col("members") <= BLOCK)
    bins = F.greatest(F.lit(1), F.ceil(F.lit(few.count() / (BLOCK / 2)))).cast("long")
    small = few.select("rep", "digest", "component", "copies", F.concat_ws("-", F.lit("g"), F.pmod(F.xxhash64("component"), bins)).alias("task"), F.lit(ALL).alias("part"))
    band = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9)
    large = stored(rows.where(F.col("members") > BLOCK).withColumn("band", band))
    counts = large.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    large = large.join(counts, ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = counts.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    large = large.join(other, ["component", "band"], "left").join(below, ["component", "band"], "left")

    def spread(n: str, first, name) -> F.Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: F.struct(name(i).alias("task"), first(i).alias("part")))) \
            .otherwise(F.array().cast("array<struct<task:string,part:int>>"))

    label = lambda b, i, c, j: F.concat_ws("-", F.lit("b"), F.col("component"), b, i, c, j)
    own, blk = F.col("band"), F.col("block")
    within = spread("blocks", lambda i: F.when(blk == i, ALL).when(blk < i, 0).otherwise(1), lambda i: label(own, F.least(blk, i), own, F.greatest(blk, i)))
    up = spread("above", lambda i: F.lit(0), lambda i: label(own, blk, own + 1, i))
    down = spread("below", lambda i: F.lit(1), lambda i: label(own - 1, i, own, blk))
    dealt = large.select("rep", "digest", "component", "copies", F.explode(F.concat(within, up, down)).alias("x")).select("rep", "digest", "component", "copies", "x.task", "x.part")
    return small.unionByName(dealt)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id): one row for each different doc_id.

    ``class_id`` is the least doc_id of all documents connected by links, a link
    being a Jaccard similarity of at least the threshold; ``n_links`` counts the
    documents linked to this one, copies included; ``copy_id`` is the least
    doc_id with the same shingle set. Documents without words are copies of each
    other and have no other links. Rows with a null doc_id give no row; rows that
    repeat a doc_id are one document, which has the text whose set's digest
    sorts first."""
    signed = stored(signatures(docs, draw(docs, threshold)))
    counts = {r["level"]: r["n"] for r in signed.select(F.explode("met").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # DEPTH + 1 rows
    names = signed.groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("s")).select("doc_id", "s.digest", "s.n")
    names = stored(names)
    reps = stored(names.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    first = reps.where("n > 0").select(F.col("rep").alias("doc_id"), "digest")
    edges = trie_edges(signed.join(first, ["doc_id", "digest"], "left_semi"), chosen_level(counts, threshold))
    groups = stored(components(edges).join(reps.select(F.col("rep").alias("node"), "digest", "copies", "n"), "node").withColumnRenamed("node", "rep"))
    held = (docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
            .join(tasks(groups, threshold), "rep"))
    compared = stored(held.groupBy("task").applyInPandas(_compare(threshold), "rep bigint, links bigint, root bigint"))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    found = (reps.select("digest", "rep", "copies").join(links, "rep", "left")
             .join(classes.select(F.col("node").alias("rep"), F.col("component").alias("class_id")), "rep", "left")
             .select("digest", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return names.select("doc_id", "digest").join(found, "digest").select("doc_id", "class_id", "n_links", F.col("rep").alias("copy_id"))


def first_of_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand first in their class, with their own
    columns; rows with a null doc_id stay."""
    keep = join(docs, threshold).where("doc_id = class_id").select("doc_id")
    kept = docs.join(keep, docs["doc_id"].cast("long") == keep["doc_id"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
