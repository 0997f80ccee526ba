"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are cut at multiples of the sequence length only; what is left of
each has a length class on a grid. A linear program over the class histogram
finds how often to use which pattern (a multiset of classes that fits one
sequence); it starts from first-fit decreasing, and a knapsack dynamic program
over the duals prices new patterns until none helps. Patterns are rounded down, the rest of the histogram is filled
first-fit decreasing, and the pieces, ranked within their class, take the
patterns' places. The program's size depends on the grid, not on the input;
ranks come from counts of hashed parts of a class, so no class is one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_stream, stored, texts, worker_kept
from .tokens import WordIds, vocabulary

SEQUENCE = 4096
GRID = 8            # tokens of a length class
END_ID = 2
GAP = 1e-4          # the program stops this close to its bound
ROUNDS = 1500       # or after so many rounds of pricing; the plan then holds the histogram with a few more sequences
RANK_ROWS = 4_000   # rows of a class that are ranked together, about


# ---- the plan: patterns over the histogram


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a multiset of items within the capacity, and its counts."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(weights, np.arange(capacity + 1), side="right")  # weights ascend
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        if k := fits[c]:
            v = best[c - weights[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], pick[c] = v[i], i
    counts, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= weights[pick[c]]
    return float(best[capacity]), counts


def decreasing_start(weights: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, inverse, use): a first basis, by first-fit decreasing. Each
    pattern takes the largest classes left and is used until one of them is
    exhausted, which becomes its row; later patterns do not hold that class, so
    the basis is triangular, and as good as first-fit decreasing."""
    n, left = len(weights), demand.astype(float)
    patterns, use, order = np.zeros((n, n)), np.zeros(n), []
    open_ = np.ones(n, bool)
    for _ in range(n):
        room, column = capacity, np.zeros(n)
        for i in np.flatnonzero(open_)[::-1]:
            if k := room // weights[i]:
                column[i] = k
                room -= k * weights[i]
        rows = np.flatnonzero(column)
        r = rows[np.argmin(left[rows] / column[rows])]
        times = left[r] / column[r]
        left = np.maximum(left - times * column, 0)
        open_[r] = False
        patterns[:, r], use[r] = column, times
        order.append(r)
    triangle = patterns[np.ix_(order, order)]  # lower triangular: rows exhausted earlier stand in earlier patterns only
    inverse = np.zeros((n, n))
    inverse[np.ix_(order, order)] = np.linalg.inv(triangle)
    return patterns, inverse, use


def linear_program(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as columns, how often each is used, fractions allowed, bound):
    the fewest sequences that hold the demand, within ``gap`` of the bound, the
    larger of that of the duals and the weight of all pieces; or what ``rounds``
    rounds of pricing reach. Either holds the demand."""
    patterns, inverse, use = decreasing_start(weights, demand, capacity)
    bound = float(weights @ demand) / capacity
    for _ in range(rounds):
        total = use.sum()
        if total - bound <= gap * total:
            break
        duals = inverse.sum(0)  # every pattern costs one sequence
        value, column = knapsack(weights, duals, capacity)
        bound = max(bound, total / value)
        if value <= 1 + 1e-9 or total - bound <= gap * total:
            break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        r = rows[np.argmin(use[rows] / step[rows])]
        theta = max(0.0, use[r] / step[r])
        use -= theta * step
        use[r] = theta
        np.maximum(use, 0, out=use)
        inverse[r] /= step[r]
        step[r] = 0
        inverse -= np.outer(step, inverse[r])
        patterns[:, r] = column
    return patterns, use, bound


def first_fit(weights: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold exactly the items left, largest first."""
    left, out = left.copy(), []
    while left.any():
        room, counts = capacity, np.zeros(len(left), np.int64)
        for i in range(len(left) - 1, -1, -1):
            if left[i] and weights[i] <= room:
                k = min(left[i], room // weights[i])
                counts[i] += k
                left[i] -= k
                room -= k * weights[i]
        out.append(counts)
    return out


def plan(histogram: dict[int, int], capacity: int = SEQUENCE // GRID) -> list[tuple[int, dict[int, int]]]:
    """[(how many sequences, {class: pieces in each})], holding exactly the
    histogram {class: pieces}; a class weighs its own number."""
    weights = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(weights):
        return []
    demand = np.array([histogram[k] for k in weights], np.int64)
    patterns, use, _ = linear_program(weights, demand.astype(float), capacity)
    out, left = [], demand.copy()
    for p in np.argsort(-use, kind="stable"):
        column = patterns[:, p].astype(np.int64)
        times = int(min(math.floor(use[p] + 1e-6), (left[column > 0] // column[column > 0]).min()))
        if times > 0:
            out.append((times, column))
            left -= times * column
    out += [(1, column) for column in first_fit(weights, left, capacity)]
    return [(times, {int(weights[i]): int(column[i]) for i in np.flatnonzero(column)}) for times, column in out]


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """{class: rows (first rank, first sequence, pieces a sequence)}, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, column in patterns:
        for c, per in column.items():
            out.setdefault(c, []).append((ranks.get(c, 0), sequence, per))
            ranks[c] = ranks.get(c, 0) + times * per
        sequence += times
    return {c: np.array(v, np.int64) for c, v in out.items()}


# ---- the pieces


def pieces_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every row's ids, the end
    id included, cut at multiples of SEQUENCE. A null text has the end id only."""
    definition = vocabulary(docs.sparkSession, tokenizer)
    end = np.array([END_ID], "<u4").tobytes()
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_kept("word ids", definition.value, lambda: WordIds(definition.value))
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(texts(batch)):
                ids = ids_of.encode(t) + end
                n = len(ids) // 4
                for s in range(0, n, SEQUENCE):
                    e = min(n, s + SEQUENCE)
                    rows.append((s, e - s, zlib.crc32(memoryview(ids)[4 * s : 4 * e]), n))
                    at.append(i)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_stream(docs.select("doc_id", "text"), cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps in each ``class``. A class
    is ranked in hashed parts, whose counts give each part its first rank."""
    parts = [F.lit(x) for c, n in histogram.items() if n > RANK_ROWS for x in (c, math.ceil(n / RANK_ROWS))]
    many = F.coalesce(F.create_map(*parts)[F.col("class")], F.lit(1)) if parts else F.lit(1)
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), many))
    counts = rows.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "length", "ids_crc32"))
    return rows.withColumn("within", within).join(first, ["class", "part"]).withColumn("rank", F.col("first") + F.col("within") - 1).drop("part", "first", "within")


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the
    pieces of all rows, each in one place of one sequence of at most SEQUENCE
    tokens. Rows that repeat a doc_id are packed like others; an empty table
    gives no piece."""
    pieces = stored(pieces_of(docs, tokenizer).withColumn("class", F.ceil(F.col("length") / GRID).cast("long")))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    where = places(plan(histogram))

    def place(batch: pa.RecordBatch) -> dict:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        cls, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("class", "rank"))
        seq, slot = np.empty(len(cls), np.int64), np.empty(len(cls), np.int64)
        for c in np.unique(cls):
            rows, table = np.flatnonzero(cls == c), where[int(c)]
            first, sequence, per = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1].T
            seq[rows], slot[rows] = sequence + (rank[rows] - first) // per, (rank[rows] - first) % per
        return columns | {"sequence_id": seq, "slot": slot}

    rows = ranked(pieces, histogram)
    placed = map_batches(rows, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id bigint, slot bigint")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def padding(packed: DataFrame) -> DataFrame:
    """One row: tokens, sequences, padded tokens and their share; sequences are
    padded to SEQUENCE, except those whose length is a power of two."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(SEQUENCE - F.col("n"))
    return filled.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sequences"), F.sum(pad).alias("padding")).withColumn(
        "share", F.col("padding") / (F.col("padding") + F.col("tokens")))
