"""Fill-in-middle transformation, a pipeline of ``pyarrow.compute`` calls.

A text is a row of units: runs of ASCII letters, and every other code point by
itself. A batch of texts is split into one list array of units and flattened
with the parent's index; a unit's ordinal is its place in the flat array less
the place of its parent's first. Two cuts of each text give every unit a role
(prefix, middle, suffix); the units of a role are filtered out, put together as
a list array again by the roles' counts, and joined to one piece a text.

Which cuts and which form a text takes is a function of its id alone, so a task
that runs again writes the same output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_stream

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values of the output format
MARKS = r"<[PSM]>"
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*"  # of UTF-8 bytes: a run of letters, or one code point
END = b"\xff"        # stands in no UTF-8 text
PLAIN_FROM = 90      # h3 % 100 from here on: the text stays as it is
SPM_BELOW = 20       # h4 % 100 below this: the suffix comes first
SLICE_BYTES = 2 << 20  # of text that is spread out as units at once; a longer text is spread out alone


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from an id (null: as an empty one)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def split_units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(units, parent, n): all units of all texts in order, the text of each,
    and how many each text has."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, rb"\0" + END), END)
    n = pc.cast(pc.subtract(pc.list_value_length(lists), 1), pa.int64())  # after the last unit stands one empty piece
    units = pc.list_flatten(lists)
    inside = pc.greater(pc.binary_length(units), 0)
    return units.filter(inside), pc.cast(pc.list_parent_indices(lists), pa.int64()).filter(inside), n


def ordinals(parent: pa.Array, n: pa.Array) -> pa.Array:
    """A unit's place in its text, from 0."""
    first = pc.subtract(pc.cumulative_sum(n), n)
    place = pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(parent)))
    return pc.subtract(pc.subtract(place, 1), pc.take(first, parent))


def rejoined(units: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """One piece a text of the units that ``role`` marks; ``counts`` of them each."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, units.filter(role)), pa.scalar(b"", units.type))


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(n, prefix, middle, suffix) of texts cut after the smaller and after the
    larger of ``first % (n + 1)`` and ``second % (n + 1)`` units."""
    units, parent, n = split_units(texts)
    at = ordinals(parent, n)
    one, other = (pc.subtract(h, pc.multiply(pc.divide(h, pc.add(n, 1)), pc.add(n, 1))) for h in (first, second))
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    before, upto = pc.less(at, pc.take(low, parent)), pc.less(at, pc.take(high, parent))
    return (n, rejoined(units, before, low), rejoined(units, pc.and_not(upto, before), pc.subtract(high, low)),
            rejoined(units, pc.invert(upto), pc.subtract(n, high)))


def _assembled(form: pa.Array, text: pa.Array, prefix: pa.Array, middle: pa.Array, suffix: pa.Array) -> pa.Array:
    p, s, m, none = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    return pc.if_else(pc.equal(form, "plain"), text, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _transform(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.cast(pc.fill_null(batch.column("text"), ""), pa.large_binary())
    h1, h2, h3, h4 = (batch.column(f"h{i}") for i in range(1, 5))
    n, prefix, middle, suffix = pieces(text, h1, h2)
    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.greater_equal(h3, PLAIN_FROM)), pc.match_substring_regex(text, MARKS))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(h4, SPM_BELOW), "spm", "psm"))
    chars = [pc.if_else(plain, None, pc.cast(pc.utf8_length(pc.cast(x, pa.large_string())), pa.int64())) for x in (prefix, middle)]
    output = pc.cast(_assembled(form, text, prefix, middle, suffix), pa.large_string())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *chars, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE_BYTES of text, one row at least."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            yield _transform(part)


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` counts the units; ``form`` is plain (output is the text; the lengths
    are null), psm or spm. A null text is empty and thereby plain; a null doc_id
    draws as an empty one; rows that repeat an id draw alike, equal rows give
    equal output. Bytes that are no UTF-8 are read as U+FFFD. Other columns are
    not read. A worker holds the units of SLICE_BYTES of text, or of one longer
    text."""
    h = draws(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"), h[0].alias("h1"), h[1].alias("h2"),
                       (h[2] % 100).alias("h3"), (h[3] % 100).alias("h4"))
    return map_stream(rows, _run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form came from. Plain text holds no mark,
    and a mark cannot arise where a piece meets one, so that the first
    occurrence of each mark is the one that was written."""
    out, head = F.col(output), len(PREFIX)

    def between(left: str, right: str) -> Column:
        start = F.instr(out, left) + head
        return F.substring(out, start, F.instr(out, right) - start)

    last = F.substring(out, F.instr(out, MIDDLE) + head, F.length(out))
    return (F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE)))
            .otherwise(F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))))
