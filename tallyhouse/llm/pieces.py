"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the
pieces drives a single-pass Viterbi.

The automaton reads a text once; at every position its output links name all
pieces that end there, and each relaxes the best score of that position. A
character that is no piece of its own costs the unknown score and becomes its
UTF-8 bytes. Ids, scores and byte pieces are those of a given model file.

No piece joins characters that never stand side by side in a piece, so a text
is cut there first and each distinct part is decoded once per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_stream, texts, worker_kept

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest piece
CACHE_PARTS = 900_000   # then the cache starts anew
RUN_CLASSES = 6         # largest sets of joined characters that get runs of their own


@dataclass(frozen=True)
class Pieces:
    """A model's pieces with spaces for the space mark."""

    text: tuple[str, ...]      # "" for control and byte pieces
    score: tuple[float, ...]
    byte_id: tuple[int, ...]   # id of each byte's piece

    @property
    def unknown_score(self) -> float:
        return min(s for t, s in zip(self.text, self.score, strict=True) if t) - UNKNOWN_PENALTY


def load(path: str) -> Pieces:
    """The pieces of a SentencePiece model file with byte fallback, identity
    normalisation and a space put before every text."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in ids]
    bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
    if len(bytes_) != 256:
        raise ValueError("the model has no byte pieces")
    return Pieces(tuple(m.id_to_piece(i).replace(SPACE_MARK, " ") if plain[i] else "" for i in ids), tuple(m.get_score(i) for i in ids),
                  tuple(bytes_[b] for b in range(256)))


def cutter(pieces: Pieces) -> re.Pattern:
    """A pattern whose matches cut any text where no piece can cross: between
    characters that no chain of pieces joins, and before spaces."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for t in pieces.text:
        body = t.lstrip(" ")
        if " " in body:
            return re.compile(r"(?s).+")
        for a, b in zip(body, body[1:], strict=False):
            parent[root(a)] = root(b)
    sets: dict[str, list[str]] = {}
    for c in parent:
        sets.setdefault(root(c), []).append(c)
    largest = sorted(("".join(map(re.escape, sorted(x))) for x in sets.values() if len(x) > 1), key=len, reverse=True)[:RUN_CLASSES]
    runs = [f"[{x}]+" for x in largest] + [f"[^ {''.join(largest)}]+"]
    return re.compile(" *(?:" + "|".join(runs) + ")| +")


class Encoder(dict):
    """part of a text -> its ids as little-endian 32-bit integers."""

    def __init__(self, pieces: Pieces):
        import ahocorasick
        super().__init__()
        self.pieces, self.unknown = pieces, pieces.unknown_score
        self.single = {t for t in pieces.text if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(pieces.text):
            if t:
                self.automaton.add_word(t, (len(t), pieces.score[i], i))
        self.automaton.make_automaton()
        self.cut = cutter(pieces)

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best-scoring segmentation; of equal ones the one whose
        last piece starts first."""
        n, low = len(part), float("-inf")
        best, back = [0.0] + [low] * n, [(0, -1)] * (n + 1)
        matches = self.automaton.iter(part)
        nxt = next(matches, None)
        for end in range(1, n + 1):
            top, how = low, (1, -1)
            while nxt is not None and nxt[0] == end - 1:
                length, score, i = nxt[1]
                s = best[end - length] + score
                if s > top:
                    top, how = s, (length, i)
                nxt = next(matches, None)
            if part[end - 1] not in self.single and (s := best[end - 1] + self.unknown) > top:
                top, how = s, (1, -1)
            best[end], back[end] = top, how
        out, end = [], n
        while end:
            length, i = back[end]
            out += [i] if i >= 0 else [self.pieces.byte_id[b] for b in reversed(part[end - 1].encode())]
            end -= length
        return out[::-1]

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.viterbi(part), "<i4").tobytes()
        if len(part) <= 64:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_PARTS:
            self.clear()
        return b"".join(map(self.__getitem__, self.cut.findall(" " + text))) if text else b""


def piece_bytes(pieces: Pieces) -> list[bytes]:
    """UTF-8 of each id; control and unknown ids give nothing."""
    out = [t.encode() for t in pieces.text]
    for b, i in enumerate(pieces.byte_id):
        out[i] = bytes([b])
    return out


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, n_ids, ids): the ids of every whole text, one row for each row
    of ``docs``. Null and empty texts have no id. The space mark itself, if it
    stands in a text, becomes bytes, so that decoding gives the text back. Bytes
    that are no UTF-8 (a cast binary) are read as U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the model, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_kept("pieces", shared.value, lambda: Encoder(shared.value))
        for batch in batches:
            ids = [encoder.encode(t.decode("utf-8", "replace")) for t in texts(batch)]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                             ["doc_id", "n_ids", "ids"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_stream(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_ids bigint, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``, and ``decoded_sha256``
    (lower-case hex of its UTF-8). Null ids give an empty text; ids outside the
    model raise an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    encoded = encoded.drop("decoded", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = piece_bytes(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            raw = [b"".join(map(spelled.__getitem__, ids or ())) for ids in column.to_pylist()]
            raw = [x[1:] if x[:1] == b" " else x for x in raw]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict(columns | {"decoded": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()),
                                                        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_stream(encoded, run, fields + ", decoded string, decoded_sha256 string")
