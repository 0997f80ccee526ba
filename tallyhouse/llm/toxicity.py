"""Toxicity: a bidirectional gated recurrent network with attention pooling
over word and character inputs, trained in numpy.

A word's input joins word features (its class log odds and a trained
embedding) and character features (the log odds of its first 3, 4 and 5
characters and the mean of trained embeddings of all its character trigrams).
Scripts without spaces are read as overlapping runs of characters, and long
words as overlapping pieces, which are words of their own. A text is read as overlapping windows of WINDOW words every STRIDE words, the
last one flush with its end; its score is that of its highest window.

Labels are of documents, so training is multiple-instance: it picks the
windows that score highest now, fits the network to them, and picks again.
The log odds that a training document sees come from the other half of the
sample. The sample is bounded in rows: at most SAMPLE documents of each label,
in the order of a hash of the id. Their whole texts are read, in tasks that
count the terms and pick the windows; only those reach the driver.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, map_stream, stored, texts, training_labels

WINDOW, STRIDE = 32, 24
SAMPLE = 1500              # documents of each label that training reads at most
SAMPLE_TASKS = 16          # tasks that read the sample
HIDDEN, ATTENTION = 8, 8
WORD_DIM, GRAM_DIM, GRAM_ROWS = 3, 4, 4096
PREFIXES = (3, 4, 5)
LONG = 16                  # a longer word is read as pieces of PIECE characters, one every STEP
PIECE, STEP = 12, 4
MIN_DOCS = 4               # a word or prefix in fewer training documents has no log odds
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 3, 4, 128, 0.01, 1e-3
STEPS = 150                # updates of a round at least, in as many more epochs
CHUNK = 2048               # windows that are scored together
CACHE_WORDS = 300_000      # then a task's word cache starts anew
THRESHOLD = 0.5
# bytes outside letters, digits and non-ASCII end a word; A-Z are lowered
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# scripts written without spaces, and how many characters of them make a word, from every character on
_UNSPACED = (
    (2, re.compile("[\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")),
    (4, re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaa7f]+")),  # Thai, Lao, Tibetan, Burmese, Khmer, Tai
)


def _runs(text: str) -> Iterator[tuple[str, int]]:
    """(characters of one kind, characters that make a word of them or 0)."""
    at = 0
    while at < len(text):
        found = [(m.start(), m.end(), n) for n, kind in _UNSPACED if (m := kind.search(text, at))]
        first, end, n = min(found, default=(len(text), len(text), 0))
        if first > at:
            yield text[at:first], 0
        if end > first:
            yield text[first:end], n
        at = end


def _cut(run: str, size: int, step: int) -> list[str]:
    """Overlapping pieces that cover a run, the last one flush with its end."""
    return [run[i : i + size] for i in [*range(0, len(run) - size, step), max(0, len(run) - size)]]


def pieces(word: bytes) -> list[bytes]:
    """The words that a stretch of bytes without ASCII space or punctuation is
    read as: other punctuation and spaces part it, unspaced scripts and words
    over LONG characters are cut into overlapping pieces. No other character
    is left out."""
    text = word.decode("utf-8", "replace")
    spaced = "".join(" " if c == "\u200b" or c >= "\x80" and unicodedata.category(c)[0] in "PZ" else c for c in text)
    out = []
    for part in spaced.split():
        for run, n in _runs(part):
            out += _cut(run, n, 1) if n else _cut(run, PIECE, STEP) if len(run) > LONG else [run]
    return [x.encode() for x in out]


@lru_cache(100_000)
def _pieces_kept(word: bytes) -> tuple[bytes, ...]:
    return tuple(pieces(word))


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(_TO_WORDS).split()
    if text.isascii() and len(max(words, key=len, default=b"")) <= LONG:
        return words
    out: list[bytes] = []
    for w in words:
        if len(w) <= LONG and w.isascii():
            out.append(w)
        else:
            out += _pieces_kept(w) if len(w) <= 64 else pieces(w)
    return out


def prefixes(word: bytes) -> list[str]:
    """The first 3, 4 and 5 characters, where the word is longer than that."""
    w = word.decode("utf-8", "replace")
    return [w[:k] for k in PREFIXES if len(w) > k]


def trigrams(word: bytes) -> list[int]:
    w = b"^" + word + b"$"
    return [zlib.crc32(w[i : i + 3]) % GRAM_ROWS for i in range(len(w) - 2)]


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover n words."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


# ---- inputs


def log_odds(seen: dict[int, Counter], n: dict[int, int]) -> dict:
    """Class log odds of each key, from how many of the n documents of each
    label hold it."""
    out = {}
    for k in {k for y in (0, 1) for k, c in seen[y].items() if c > 1}:
        a, b = seen[1][k], seen[0][k]
        if a + b >= MIN_DOCS:
            z = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
            if abs(z) > 0.3:
                out[k] = max(-2.0, min(6.0, z)) / 3
    return out


def keys_of(word: bytes) -> list:
    return [word, *prefixes(word)]


def odds_row(word: bytes, odds: dict) -> list[float]:
    p = [odds.get(x, 0.0) for x in prefixes(word)]
    return [odds.get(word, 0.0), *p, *[0.0] * (len(PREFIXES) - len(p))]


# ---- network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class _Rows:
    """Rows of a table by step, gathered when a step asks for them."""

    def __init__(self, table: np.ndarray, index: np.ndarray):
        self.table, self.index = table, index

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, t: int) -> np.ndarray:
        return self.table.take(self.index[t], axis=0, mode="wrap")


@dataclass
class Network:
    p: dict[str, np.ndarray]
    odds: dict
    vocabulary: dict[bytes, int]  # rows of the word embedding; 0 is any other word
    shift: float = 0.0            # from the sample's class shares to those of all labels

    @classmethod
    def fresh(cls, odds: dict, vocabulary: dict[bytes, int], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        d, h, a = 1 + len(PREFIXES) + WORD_DIM + GRAM_DIM, HIDDEN, ATTENTION
        draw = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        p = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "gram": draw(GRAM_ROWS, GRAM_DIM) * 6,
             "att": draw(2 * h, a), "att_b": np.zeros(a, np.float32), "att_v": draw(a, 1)[:, 0], "out": draw(2 * h, 1)[:, 0], "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            p |= {side + "x": draw(d, 3 * h), side + "u": draw(h, 3 * h), side + "b": np.zeros(3 * h, np.float32)}
        return cls(p, odds, vocabulary)

    # inputs of words: log odds, word embedding, mean trigram embedding
    def inputs(self, odds: np.ndarray, word: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(g) for g in grams])
        flat = self.p["gram"][np.concatenate(grams)] if len(grams) else np.zeros((0, GRAM_DIM), np.float32)
        mean = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None] if len(grams) else flat
        return np.concatenate([odds, self.p["word"][word], mean], axis=1).astype(np.float32)

    def project(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p[side + "x"] + self.p[side + "b"]

    def recur(self, gates: list[np.ndarray], side: str, mask: np.ndarray | None, keep: list | None = None) -> list[np.ndarray]:
        """Hidden states after each step; gates are projected inputs by step."""
        h, u = np.zeros((len(gates[0]), HIDDEN), np.float32), self.p[side + "u"]
        order = range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1)
        out: list = [None] * len(gates)
        for t in order:
            uh, g = h @ u, gates[t]
            zr = sigmoid(g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN])
            z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], uh[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * un)
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, un))
            h = new if mask is None else np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple:
        """Attention over the steps of (steps, windows, 2 x hidden) states."""
        u = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = u @ self.p["att_v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        return pooled @ self.p["out"] + self.p["out_b"][0], pooled, w, u

    def logits(self, forward: np.ndarray, backward: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Of windows of word rows (-1 pads the end); forward and backward are
        the projected inputs of all words."""
        out = np.empty(len(windows), np.float32)
        for s in range(0, len(windows), CHUNK):
            w = np.ascontiguousarray(windows[s : s + CHUNK].T)
            mask = w >= 0
            mask = None if mask.all() else mask
            states = np.empty((len(w), w.shape[1], 2 * HIDDEN), np.float32)
            for k, table in enumerate((forward, backward)):
                for t, h in enumerate(self.recur(_Rows(table, w), "fb"[k], mask)):
                    states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            out[s : s + CHUNK] = self.pool(states, mask)[0]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss, by parameter and by input x (steps, windows, d)."""
        p, h, g = self.p, HIDDEN, {}
        kept = {"f": [], "b": []}
        gates = {s: self.project(x, s) for s in "fb"}
        states = np.concatenate([np.stack(self.recur(list(gates[s]), s, mask, kept[s])) for s in "fb"], axis=2)
        logit, pooled, w, u = self.pool(states, mask)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, np.array([d.sum()])
        dpooled = d[:, None] * p["out"]
        dw = np.einsum("nh,tnh->tn", dpooled, states)
        de = w * (dw - (w * dw).sum(0))
        du = de[:, :, None] * p["att_v"] * (1 - u * u)
        g["att_v"], g["att_b"] = np.einsum("tn,tna->a", de, u), du.sum((0, 1))
        g["att"] = np.einsum("tnh,tna->ha", states, du)
        dstates = w[:, :, None] * dpooled + du @ p["att"].T
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            gu, dgates, back = np.zeros_like(p[s + "u"]), np.zeros_like(gates[s]), np.zeros((x.shape[1], h), np.float32)
            for t, prev, z, r, n, un in reversed(kept[s]):
                dh = dstates[t][:, k * h : (k + 1) * h] + back
                live = mask[t][:, None]
                dnew = np.where(live, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz, dr = dnew * (prev - n) * z * (1 - z), dn * un * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                duh = np.concatenate([dz, dr, dn * r], axis=1)
                gu += prev.T @ duh
                back = np.where(live, dnew * z, dh) + duh @ p[s + "u"].T
            g[s + "u"], g[s + "b"] = gu, dgates.sum((0, 1))
            g[s + "x"] = np.einsum("tnd,tng->dg", x, dgates)
            dx += dgates @ p[s + "x"].T
        return g, dx


# ---- training


def half_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) // 7 % 2


@dataclass
class Pick:
    """The windows of a document that a round learns from."""

    doc_id: object
    label: int
    best: list[bytes]
    other: list[bytes]  # a random one


def picked(doc_id, words: list[bytes], label: int, halves: list[dict], net: Network | None, turn: int) -> Pick:
    """Of all windows of a text the one that scores highest, by the log odds
    alone where there is no network yet, and a random one."""
    rows: dict[bytes, int] = {}
    ids = np.array([rows.setdefault(w, len(rows)) for w in words])
    table = np.array([odds_row(w, halves[half_of(doc_id)]) for w in rows], np.float32)
    starts = np.array(window_starts(len(ids)))
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(ids, (0, max(0, WINDOW - len(ids))), constant_values=-1), WINDOW)
    if net is None:
        score = np.append(table.max(1) + 0.2 * table.sum(1), 0)[windows[starts]].sum(1)
    else:
        x = net.inputs(table, np.array([net.vocabulary.get(w, 0) for w in rows]), [np.array(trigrams(w)) for w in rows])
        score = net.logits(net.project(x, "f"), net.project(x, "b"), windows[starts])
    best, other = starts[int(score.argmax())], starts[zlib.crc32(f"{doc_id} {turn}".encode()) % len(starts)]
    return Pick(doc_id, label, words[best : best + WINDOW], words[other : other + WINDOW])


def train(sample: list[tuple[int, bytes, int]], share: float | None = None, seed: int = 1) -> Network:
    """From (id, text, label) rows; ``share`` is the share of label 1 among all
    labels. Without both labels the network answers that share for all texts."""
    docs = [(i, words, y) for i, text, y in sorted(sample) if (words := words_of(text))]
    seen = {(half, y): Counter() for half in (0, 1) for y in (0, 1)}
    for i, words, y in docs:
        seen[half_of(i), y].update({k for w in set(words) for k in keys_of(w)})
    n = Counter((half_of(i), y) for i, _, y in docs)
    return fitted(seen, n, lambda halves, net, turn: [picked(i, words, y, halves, net, turn) for i, words, y in docs], share, seed)


def train_in_tasks(sample: DataFrame, share: float | None = None, seed: int = 1) -> Network:
    """``train`` on a table (doc_id, text, label). The driver receives the keys
    that MIN_DOCS documents hold, and two windows of a document each round."""
    spark = sample.sparkSession

    def count(batch: pa.RecordBatch) -> dict:
        n: Counter = Counter()
        for i, text, y in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
            words = set(words_of(text))
            if words:
                cell = 2 * half_of(i) + y
                n.update((cell, k) for k in {b"", *(b"w" + k if isinstance(k, bytes) else b"p" + k.encode() for w in words for k in keys_of(w))})
        return {"cell": pa.array([c for c, _ in n], pa.int32()), "key": pa.array([k for _, k in n], pa.binary()), "n": pa.array(list(n.values()), pa.int64())}

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)]
    counts = map_batches(sample, count, "cell int, key binary, n bigint").groupBy("key").agg(*cells).where((F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3") >= MIN_DOCS) | (F.length("key") == 0))
    seen, n = {(half, y): Counter() for half in (0, 1) for y in (0, 1)}, Counter()
    for row in counts.toLocalIterator():
        key = bytes(row["key"])
        k = key[1:] if key[:1] == b"w" else key[1:].decode()
        for half, y in seen:
            v = row[f"c{2 * half + y}"]
            if not key:
                n[half, y] = v
            elif v:
                seen[half, y][k] = v

    kind = dict(sample.dtypes)["doc_id"]

    def pick(halves: list[dict], net: Network | None, turn: int) -> list[Pick]:
        shared = spark.sparkContext.broadcast((halves, net))  # as large as the bounded sample allows

        def run(batch: pa.RecordBatch) -> dict:
            rows = [picked(i, words, y, *shared.value, turn) for i, text, y in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True)
                    if (words := words_of(text))]
            return {"doc_id": pa.array([r.doc_id for r in rows], batch.schema.field(0).type), "label": pa.array([r.label for r in rows], pa.int32()),
                    "best": pa.array([r.best for r in rows], pa.list_(pa.binary())), "other": pa.array([r.other for r in rows], pa.list_(pa.binary()))}

        rows = map_batches(sample, run, f"doc_id {kind}, label int, best array<binary>, other array<binary>").collect()  # bounded: the sample's rows
        shared.unpersist()
        return sorted((Pick(r["doc_id"], r["label"], list(map(bytes, r["best"])), list(map(bytes, r["other"]))) for r in rows), key=lambda r: r.doc_id)

    return fitted(seen, n, pick, share, seed)


def fitted(seen: dict, n: dict, pick, share: float | None, seed: int) -> Network:
    """From the counts of keys ``seen`` and documents ``n`` by (half, label);
    ``pick(halves, net, turn)`` gives the windows of a round."""
    rng = np.random.default_rng(seed)
    docs = {y: n[0, y] + n[1, y] for y in (0, 1)}
    if not docs[0] or not docs[1]:
        net = Network.fresh({}, {})
        net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
        rate = share if share is not None else docs[1] / sum(docs.values()) if sum(docs.values()) else 0.5
        net.shift = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        return net
    halves = [log_odds({y: seen[1 - half, y] for y in (0, 1)}, {y: n[1 - half, y] for y in (0, 1)}) for half in (0, 1)]
    odds = log_odds({y: seen[0, y] + seen[1, y] for y in (0, 1)}, docs)
    seen.clear()
    net = Network.fresh(odds, {w: i + 1 for i, w in enumerate(sorted(k for k in odds if isinstance(k, bytes)))}, seed)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(ROUNDS):
        picks = pick(halves, net if turn else None, turn)
        texts_of = [(p.doc_id, p.best, p.label) for p in picks] + [(p.doc_id, p.other, 0) for p in picks if not p.label]  # a random window of a toxic text may be clean
        rows: dict[tuple[bytes, int], int] = {}
        windows = np.full((len(texts_of), WINDOW), -1)
        for i, (doc_id, words, _) in enumerate(texts_of):
            windows[i, : len(words)] = [rows.setdefault((w, half_of(doc_id)), len(rows)) for w in words]
        table = np.array([odds_row(w, halves[half]) for w, half in rows], np.float32)
        word = np.array([net.vocabulary.get(w, 0) for w, _ in rows])
        grams = [np.array(trigrams(w), np.int16) for w, _ in rows]
        chosen, target = np.arange(len(windows)), np.array([y for *_, y in texts_of], np.float32)
        for _ in range(max(EPOCHS, math.ceil(STEPS / math.ceil(len(chosen) / BATCH)))):
            order = rng.permutation(len(chosen))
            for s in range(0, len(order), BATCH):
                part = order[s : s + BATCH]
                w = windows[chosen[part]].T
                mask = w >= 0
                used, place = np.unique(np.where(mask, w, 0), return_inverse=True)
                lists = [grams[i] for i in used]
                x = net.inputs(table[used], word[used], lists)
                g, dx = net.gradients(x[place.reshape(w.shape)], mask, target[part])
                dused = np.zeros_like(x)
                np.add.at(dused, place.ravel(), dx.reshape(-1, dx.shape[2]))
                a, b = 1 + len(PREFIXES), 1 + len(PREFIXES) + WORD_DIM
                g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
                np.add.at(g["word"], word[used], dused[:, a:b])
                sizes = np.array([len(x) for x in lists])
                np.add.at(g["gram"], np.concatenate(lists), np.repeat(dused[:, b:] / sizes[:, None], sizes, axis=0))
                step += 1
                for k, v in net.p.items():  # Adam with decay
                    m, q = state[k]
                    d = g[k] + DECAY * v
                    m += 0.1 * (d - m)
                    q += 0.001 * (d * d - q)
                    v -= (RATE / (1 + turn) * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if share is not None and 0 < share < 1:
        mine = docs[1] / (docs[0] + docs[1])
        net.shift = math.log(share / (1 - share)) - math.log(mine / (1 - mine))
    return net


def sample_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, float | None]:
    """At most ``size`` labelled documents of each label as a table (doc_id,
    text, label), and the share of label 1 among all labels that may be learnt
    from."""
    known = training_labels(labels, "toxic").withColumn("label", F.least("label", F.lit(1)))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    first = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]  # bounded: the sample
    ids = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    return rows, n.get(1, 0) / sum(n.values()) if n else None


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[tuple[int, bytes, int]], float | None]:
    """``sample_rows`` on the driver, for small samples."""
    rows, share = sample_rows(docs, labels, size)
    return [(r["doc_id"], r["text"].encode(), r["label"]) for r in rows.collect()], share


# ---- scoring


class Scorer:
    """Scores texts; keeps the projected inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.forward = self.backward = np.zeros((0, 3 * HIDDEN), np.float32)

    def learn(self, words: list[bytes]) -> None:
        net = self.net
        x = net.inputs(np.array([odds_row(w, net.odds) for w in words], np.float32), np.array([net.vocabulary.get(w, 0) for w in words]), [np.array(trigrams(w)) for w in words])
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.forward = np.concatenate([self.forward, net.project(x, "f")])
        self.backward = np.concatenate([self.backward, net.project(x, "b")])

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """P(toxic) of each text; a text without words scores an empty window."""
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        split = [words_of(t) for t in batch]
        new = set().union(*split) - self.rows.keys()
        if new:
            self.learn(sorted(new))
        full, short, full_of, short_of = [], [], [], []
        for i, words in enumerate(split):
            ids = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            if len(ids) >= WINDOW:
                starts = np.array(window_starts(len(ids)))
                full.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
                full_of.append(np.full(len(starts), i))
            else:
                short.append(np.pad(ids, (0, WINDOW - len(ids)), constant_values=-1))
                short_of.append(i)
        out = np.full(len(batch), -np.inf)
        if not len(self.forward):
            self.learn([b"^"])  # a row for the padding of empty windows to point at
        if full:
            np.maximum.at(out, np.concatenate(full_of), self.net.logits(self.forward, self.backward, np.concatenate(full)))
        if short:
            out[short_of] = self.net.logits(self.forward, self.backward, np.stack(short))
        return 1 / (1 + np.exp(-np.clip(out + self.net.shift, -40, 40)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, size: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.
    All windows of a text count. Null and empty texts are scored as an empty
    window; null ids are not labelled and not held out."""
    sample, share = sample_rows(docs, labels, size)
    net = train_in_tasks(stored(sample.repartition(SAMPLE_TASKS)), share)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # as large as the bounded sample allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": scorer.scores(texts(batch))})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    scored = map_stream(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
