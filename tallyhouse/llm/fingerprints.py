"""Document fingerprints by consistent weighted sampling, in DataFrame
expressions only.

A text's terms are its words, weighted by how often they stand in it. A weight
over 1 is cut into layers at 1, 2, 3, 4, 6, 8, 12, 16, 24, ...; each layer is a
term of its own, which leaves the sums of minima and of maxima as they are and
keeps a frequent word from deciding about one bin alone. Each
term falls into one of BINS bins by its hash; in a bin, improved consistent
weighted sampling draws r and c from Gamma(2, 1) and beta from U(0, 1) for
each term, all three functions of the term's hash, and keeps the term with the
smallest

    ln a = ln c - r (t - beta) - r,   t = floor(ln w / r + beta)

as (term, t). The fingerprint is the bins' samples; an empty bin takes the
sample of the next bin that has one. Two fingerprints agree in a bin with the
probability of the generalised Jaccard similarity (sum of minima over sum of
maxima of the weights) of what falls there, so the share of agreeing bins
estimates that of the texts. One draw a term, not one for each term and bin,
keeps the work in proportion to the text.

Everything up to the samples of a text happens in the partition that holds its
block of ids; the texts are shuffled once for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import with_consecutive_ids
from .common import stored

BINS = 64
BLOCK = 64            # consecutive ids that are ordered together, a power of two
NULL_BITS = 24        # rows without an id are dealt to this power of two blocks, by their texts' digests
_SCALE, _SHIFT, _TOKEN = 1 << 31, 200, 1 << 16  # ln a as an integer of 40 bits, before 16 bits of the sample
EMPTY = -1            # sample of a text without words


def block_of(doc_id: str) -> Column:
    """The block of an id: a shift, as a division would round large ids."""
    return F.shiftright(F.col(doc_id), BLOCK.bit_length() - 1)


def chain(blocks: DataFrame) -> DataFrame:
    """(block, next_block) of a table of blocks: the next larger one, after the
    largest the smallest. Works on block numbers only, ranked over range
    partitions: sparse ids, with a block for nearly each, stay spread out."""
    ranked = with_consecutive_ids(blocks.select("block").distinct(), ["block"], "rank")
    first = ranked.where("rank = 1").first()  # one row
    after = ranked.select(F.col("block").alias("next_block"), (F.col("rank") - 1).alias("rank"))
    return ranked.join(after, "rank", "left").select("block", F.coalesce("next_block", F.lit(first and first["block"])).cast("long").alias("next_block"))


def with_next(rows: DataFrame, order: list[str], value: str, name: str, links: DataFrame) -> DataFrame:
    """``rows`` (with a column block that agrees with the order) and ``name``:
    the value of the next row, for the last row that of the first; ``place`` is
    the row's place in its block, from 1. ``links`` is the ``chain`` of the rows."""
    w = Window.partitionBy("block").orderBy(*order)
    placed = rows.withColumns({"place": F.row_number().over(w), "_next": F.lead(value).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    first = placed.where("place = 1").select(F.col("block").alias("next_block"), F.col(value).alias("_first"))
    link = links.join(first, "next_block").select("block", "_first")
    return (placed.join(link, "block", "left").withColumn(name, F.when(F.col("_last"), F.col("_first")).otherwise(F.col("_next")))
            .drop("_next", "_last", "_first"))


def uniform(h: Column, salt: int) -> tuple[Column, Column]:
    """Two numbers in (0, 1), functions of a hash."""
    x = F.xxhash64(h, F.lit(salt))
    half = float(1 << 32)
    return (F.shiftrightunsigned(x, 32) + 0.5) / half, (x.bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) / half


def layers(weight: Column) -> Column:
    """The lower ends of a weight's layers."""
    ends = F.array(*[F.lit(x) for x in sorted({0, 1, 2, 3, *(b << k for k in range(1, 30) for b in (2, 3))})])
    return F.when(weight <= 1, F.array(F.lit(0))).when(weight <= 4, F.sequence(F.lit(0), weight.cast("int") - 1)).otherwise(F.filter(ends, lambda x: x < weight))


def sample(h: Column, weight: Column) -> Column:
    """ln a and the sample (term, t) of a term as one integer, ordered by ln a;
    null where the weight is 0."""
    (a, b), (c, d), (beta, _) = uniform(h, 1), uniform(h, 2), uniform(h, 3)
    r, ln_c = -F.log(a * b), F.log(-F.log(c * d))
    t = F.floor(F.log(weight.cast("double")) / r + beta)
    ln_a = ln_c - r * (t - beta) - r
    token = F.pmod(F.xxhash64(h, t, F.lit(4)), F.lit(_TOKEN))
    return F.when(weight > 0, F.floor((ln_a + _SHIFT) * _SCALE) * _TOKEN + token)


def words(text: str) -> Column:
    return F.split(text, "[ \\t\\n\\x0B\\f\\r]+")


def filled(samples: Column, side: str) -> Column:
    """The sample of every bin: samples are the non-empty bins as (bin, side)."""
    def spread(own: Column) -> Column:
        token = lambda x: F.pmod(x[side], F.lit(_TOKEN)).cast("int")
        before = lambda i: F.when(i > 0, own[F.greatest(i - 1, F.lit(0))]["bin"]).otherwise(F.lit(-1))
        runs = F.flatten(F.transform(own, lambda x, i: F.array_repeat(token(x), (x["bin"] - before(i)).cast("int"))))
        rest = F.array_repeat(token(own[0]), (F.lit(BINS - 1) - own[F.size(own) - 1]["bin"]).cast("int"))
        return F.when(F.size(own) > 0, F.concat(runs, rest)).otherwise(F.array_repeat(F.lit(EMPTY), BINS))

    own = F.filter(samples, lambda x: x[side].isNotNull())
    return F.transform(F.array(own), spread)[0]  # bound once: a lambda's argument is not worked out again


def fingerprint_arrays(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """(keys, one array of BINS samples per side) of the text columns ``sides``.
    ``keys`` name a row and its partitioning; nothing is shuffled if the rows
    are partitioned by one of them."""
    n = len(sides)
    both = F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("t")) for i, s in enumerate(sides)])
    spelled = texts.select(*keys, F.explode(both).alias("s")).select(*keys, "s.side", F.explode(words("s.t")).alias("word"))
    h = F.when(F.col("word") != "", F.xxhash64("word"))
    weights = (spelled.select(*keys, "side", h.alias("h")).groupBy(*keys, "h")
               .agg(*[F.sum(F.when(F.col("side") == i, F.lit(1)).otherwise(F.lit(0))).alias(f"w{i}") for i in range(n)]))
    layered = weights.select("*", F.explode(layers(F.greatest(*[f"w{i}" for i in range(n)], F.lit(0)))).alias("low"))
    width = F.when(F.col("low") < 4, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("low"))) - 1))
    layered = layered.select(*keys, F.when(F.col("low") == 0, F.col("h")).when(F.col("h").isNotNull(), F.xxhash64("h", "low")).alias("h"), *[
        F.least(F.greatest(F.col(f"w{i}") - F.col("low"), F.lit(0)), width).alias(f"w{i}") for i in range(n)])
    drawn = layered.select(*keys, F.pmod(F.xxhash64("h", F.lit(0)), F.lit(BINS)).cast("int").alias("bin"), "h", *[
        F.when(F.col("h").isNotNull(), sample(F.col("h"), F.col(f"w{i}"))).alias(f"m{i}") for i in range(n)])
    least = drawn.groupBy(*keys, "bin").agg(*[F.min(f"m{i}").alias(f"m{i}") for i in range(n)])
    rows = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", *[f"m{i}" for i in range(n)]))).alias("samples"))
    return rows.select(*keys, *[filled(F.col("samples"), f"m{i}").alias(s) for i, s in enumerate(sides)])


def likeness(a: str, b: str) -> Column:
    """Share of the bins in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))


def spelled_out(samples: str) -> Column:
    """A fingerprint as a string: four hex digits a bin, dashes without words."""
    return F.array_join(F.transform(samples, lambda x: F.when(x < 0, F.lit("----")).otherwise(F.lpad(F.lower(F.hex(x)), 4, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): one row for each row of ``docs``.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many of the next row's text, in the order of doc_id (null first,
    by the SHA-256 of their texts) and text; the last row's next is the first. A null text is empty. Texts
    without words have a fingerprint of their own. Rows that repeat a doc_id
    follow each other; ids are taken to be nearly unique, as rows of one id are
    ordered in one task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)))
    salt = F.conv(F.substring("digest", 1, NULL_BITS // 4), 16, 10).cast("long")
    rows = rows.withColumn("block", F.coalesce(block_of("doc_id"), F.lit(-(1 << 62)) + salt))
    links = chain(rows)
    ordered = with_next(rows, ["doc_id", "digest", "text"], "text", "next_text", links).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = ordered.select("block", "place", "doc_id", "n_chars", "text", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    prints = fingerprint_arrays(edited, ["block", "place"], ["text", "edited"]).withColumnsRenamed({"text": "own", "edited": "changed"})
    known = edited.select("block", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    table = stored(known.join(prints, ["block", "place"]).withColumnRenamed("place", "at"))
    return with_next(table, ["at"], "own", "following", links).select(
        "doc_id", "n_chars", "edited_sha256", spelled_out("own").alias("fingerprint"), spelled_out("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
