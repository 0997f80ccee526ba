"""License scans: base phrases, and an exact containment join of text blocks
with license templates.

Tokens are ordered by their frequency in the corpus, rarest first (counted
over all texts, for the templates' tokens only). A block that contains at
least the threshold's share of a template must share a token with the
template's prefix, its rarest |T| - ceil(t |T|) + 1 tokens (prefix filter) and
hold ceil(t |T|) of its tokens (length filter). Such a block lies around a
place of a prefix token, so only the template's tokens less than a block away
from one are looked at (positional filter). What passes is verified by the
exact overlap.

Blocks of a template with m words are its windows of 2m words at every start;
running counts over the places of the template's tokens change only where one
enters or leaves a window. A block must also hold the template's marks, the
words that tell its license from its neighbours.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

THRESHOLD = 0.8
# fixed values: phrases and their labels
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# fixed values: notices as published by the licenses' authors, and common short notices
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
# fixed values: what tells a template's license from its neighbours. A template that holds the words needs one of the
# spellings in the block, besides the threshold's share of its tokens
MARKS = (
    ("apache", ("apache",)), ("mit", ("mit",)), ("mozilla", ("mozilla",)), ("associated documentation", ("associated documentation",)),
    ("without fee", ("or without fee", "with or without")), ("general public", ("general",)),
    ("nc", ("nc", "noncommercial", "non commercial")), ("noncommercial", ("nc", "noncommercial", "non commercial")),
    ("sharealike", ("sa", "sharealike", "share alike")),
)
# a mark's word does not count where one of these stands among the three words before it: GNU Lesser General Public License
NOT_AFTER = {b"general": frozenset((b"lesser", b"library", b"affero"))}
# bytes that are not of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lowered become spaces
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: int                 # m: blocks have 2m words
    tokens: tuple[bytes, ...]  # distinct, rarest first
    need: int                  # tokens that a block must contain
    marks: tuple[tuple[tuple[bytes, ...], ...], ...] = ()  # of each, one spelling must stand in a block

    @property
    def prefix(self) -> tuple[bytes, ...]:
        """The rarest tokens, one of which any block must hold."""
        return self.tokens[: len(self.tokens) - self.need + 1]


def token_counts(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How often each template token stands in all texts; at most one row per
    template token reaches the driver."""
    tokens = frozenset(w.encode() for _, t in templates for w in t.split())

    def count(batch: pa.RecordBatch) -> dict:
        n = dict.fromkeys(tokens, 0)
        for t in texts(batch):
            for w in words_of(t):
                if w in n:
                    n[w] += 1
        return {"token": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())}

    rows = map_batches(docs.select("text"), count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {r["token"].encode(): r["n"] for r in rows}


def marks_of(text: str) -> list[tuple[str, ...]]:
    """The spellings of each mark that a template holds."""
    return [spellings for mark, spellings in MARKS if f" {mark} " in f" {text} "]


def prepared(counts: dict[bytes, int], threshold: float = THRESHOLD, templates=TEMPLATES) -> list[Template]:
    out = []
    for label, text in templates:
        words = text.encode().split()
        tokens = tuple(sorted(set(words), key=lambda w: (counts.get(w, 0), w)))
        marks = tuple(tuple(tuple(x.encode().split()) for x in spellings) for spellings in marks_of(text))
        out.append(Template(label, len(words), tokens, math.ceil(threshold * len(tokens) - 1e-9), marks))
    return out


def mark_places(words: list[bytes], spellings: tuple[tuple[bytes, ...], ...]) -> list[tuple[int, int]]:
    """(first word, last word) of every place of a mark, in order."""
    out = []
    for spelling in spellings:
        at, k, barred = -1, len(spelling), NOT_AFTER.get(spelling[0], frozenset())
        for _ in range(words.count(spelling[0])):
            at = words.index(spelling[0], at + 1)
            if tuple(words[at : at + k]) == spelling and not barred.intersection(words[max(0, at - 3) : at]):
                out.append((at, at + k - 1))
    return sorted(out)


def close_to(anchors: list[int], reach: int) -> Callable[[int], bool]:
    """Whether a place is less than ``reach`` words from one of the anchors, which are sorted."""
    def near(i: int) -> bool:
        k = bisect(anchors, i)
        return (k > 0 and i - anchors[k - 1] < reach) or (k < len(anchors) and anchors[k] - i < reach)

    return near


def every_block(words: list[bytes], templates: list[Template]) -> list[tuple[str, float, int]]:
    """(label, containment, first word of the block) of the best window of each
    run of neighbouring starts whose windows meet the template's threshold and
    hold its marks."""
    found, places, present = [], defaultdict(list), set(words)
    wanted = []
    for t in templates:
        if any(w in present for w in t.prefix) and sum(w in present for w in t.tokens) >= t.need:
            marks = [mark_places(words, m) for m in t.marks]
            if all(marks):
                wanted.append((t, marks))
    tokens = frozenset().union(*(t.tokens for t, _ in wanted))
    for i, w in enumerate(words if wanted else ()):
        if w in tokens:
            places[w].append(i)
    for t, marks in wanted:
        size = 2 * t.words
        near = close_to(sorted(i for w in t.prefix for i in places.get(w, ())), size)
        held_by = {w: spots for w in t.tokens if (spots := [(i, i) for i in places.get(w, ()) if near(i)])}
        if len(held_by) < t.need:
            continue
        last = max(0, len(words) - size)  # later windows are parts of that one
        change: dict[int, list[int]] = defaultdict(lambda: [0, 0])  # start -> tokens, marks that enter less those that leave
        for kind, spots in [*((0, spots) for spots in held_by.values()), *((1, m) for m in marks)]:
            free = 0  # first start whose window does not hold the token yet
            for first, end in spots:
                a, b = max(free, end - size + 1), min(first, last)
                if a <= b:
                    change[a][kind] += 1
                    change[b + 1][kind] -= 1
                    free = b + 1
        n = held = best = at = 0
        for start in sorted(change):
            n, held = n + change[start][0], held + change[start][1]
            if n < t.need or held < len(marks):
                if best:
                    found.append((t.label, best / len(t.tokens), at))
                best = 0
            elif n > best:
                best, at = n, start
    return found


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(needle, at + 1)
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, blocks): one row for each row of ``docs``.

    ``labels`` are the base labels and those of templates contained in a block
    at the threshold or above, together with their marks; ``score`` is 1 where a base phrase stands, else
    the best containment, else 0; ``blocks`` lists the matching blocks as
    (label, containment, first word). Null and empty texts have no word."""
    ready = prepared(token_counts(docs, templates), threshold, templates)

    def judge(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in texts(batch):
            words = words_of(t)
            places, blocks = phrase_places(words), every_block(words, ready)
            base = {label for _, label in places}
            rows.append((len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)),
                         ",".join(sorted(base | {x[0] for x in blocks})), 1.0 if places else max((x[1] for x in blocks), default=0.0),
                         [{"label": a, "containment": b, "first_word": c} for a, b, c in blocks]))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                 pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])))
        return {"doc_id": batch.column(0)} | {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)}

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), judge,
                       f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
                       "score double, blocks array<struct<label: string, containment: double, first_word: bigint>>")
