"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

*Inputs.* Each word of a text (lower case, without punctuation at its ends) gives a vector of a word embedding (of
words that training rows use often enough), a character embedding (mean over its hashed character n-grams, so that
unseen forms of a word still resemble it) and three log odds learned from the training rows: of the word, and the
largest and mean one of its n-grams.

*Network.* A window of ``WINDOW`` words goes through two GRUs, one from each side; attention weighs their states and the
weighted sum gives a logit. All windows of a text, overlapping by half, are scored; the largest counts.

*Training.* A label says that a text is toxic, not where. Each epoch scores all windows of the training texts,
takes the highest window of every text (and, of clean texts, another one at random), and learns from these by
back-propagation through time with Adam. Log odds of a training text come from the other half of the rows, so the
network does not learn to trust what it has seen. Scores are then shifted so that 0.7 is the threshold of the best F1.

*Bounds.* Training uses at most ``max_rows`` labelled rows of each class, by hash order, of at most ``max_chars``
characters; these go to the driver, and the model (under 10 MB, whatever the corpus) to the tasks. Scoring covers whole
texts of all rows, row by row, without a shuffle. Labels, language, source and ids are never inputs.

Edge cases: null and empty texts are one empty window; a text shorter than a window is one window; rows without
a label are scored like all others; without both classes among the training labels every score is 0.5;
repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW, STRIDE = 64, 32
#: Learning rate of the embeddings, relative to the other weights.
EMBEDDING_RATE = 0.02
BUCKETS = 1 << 16  # of character n-grams
GRAMS = (3, 4, 5)  # bytes of an n-gram, with a mark at either end of the word
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*$%&#|/\\-_=+@~`^0123456789"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n-gram length: hashed n-grams end to end, the words that have any, and where each begins."""
    raw = [b"\x01" + w.encode("utf-8", "replace") + b"\x02" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    start = np.cumsum(size) - size
    out = []
    for n in GRAMS:
        have = np.flatnonzero(size >= n)
        many = size[have] - n + 1
        begin = np.cumsum(many) - many
        at = np.repeat(start[have] - begin, many) + np.arange(many.sum())
        h = np.full(len(at), n, np.uint32)
        for j in range(n):
            h = (h ^ byte[at + j]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
        out.append(((h * np.uint32(2654435769) >> np.uint32(16)).astype(np.int64), have, begin))
    return out


def gram_counts(found, n_words: int) -> np.ndarray:
    total = np.zeros(n_words)
    for flat, have, begin in found:
        total[have] += np.diff(np.concatenate((begin, [len(flat)])))
    return np.maximum(total, 1)


@dataclass
class Text:
    """Words of some texts as numbers of a shared word list, and their windows."""

    words: list[str]
    windows: np.ndarray  # (windows, WINDOW) word numbers, -1 beyond the end
    of: np.ndarray  # text of each window


def windows_of(texts: Sequence[str]) -> Text:
    raw: dict[str, int] = {}
    rows, of = [], []
    for d, text in enumerate(texts):
        tokens = text.lower().split()
        own = np.fromiter((raw.setdefault(t, len(raw)) for t in tokens), np.int64, len(tokens))
        n = max(1, -(-max(len(own) - WINDOW, 0) // STRIDE) + 1)
        full = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
        full[:len(own)] = own
        rows.append(np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE])
        of.append(np.full(n, d))
    bare: dict[str, int] = {}
    number = np.array([bare.setdefault(t.strip(EDGE) or "_", len(bare)) for t in raw] + [-1], np.int64)
    return Text(list(bare), number[np.concatenate(rows)], np.concatenate(of))


class Odds:
    """Log odds of words and n-grams, by the number of toxic and clean texts that hold them."""

    def __init__(self):
        self.word = Counter(), Counter()
        self.gram = np.zeros((2, BUCKETS))
        self.texts = [0, 0]

    def add(self, words: list[str], label: int) -> None:
        self.word[label].update(words)
        if words:
            self.gram[label, np.unique(np.concatenate([flat for flat, _, _ in grams(words)]))] += 1
        self.texts[label] += 1

    def tables(self) -> tuple[dict[str, float], np.ndarray]:
        n0, n1 = (n + 2 for n in self.texts)

        def odds(clean, toxic):
            return np.where(clean + toxic >= 3, np.log((toxic + 0.5) / n1) - np.log((clean + 0.5) / n0), 0)

        keys = [w for w in self.word[0].keys() | self.word[1].keys() if self.word[0][w] + self.word[1][w] >= 3]
        values = odds(np.array([self.word[0][w] for w in keys]), np.array([self.word[1][w] for w in keys])) if keys else []
        return dict(zip(keys, np.asarray(values).tolist(), strict=True)), odds(self.gram[0], self.gram[1]).astype(np.float32)


def odds_features(words: Sequence[str], found, tables) -> np.ndarray:
    """(words, 3): log odds of the word, the largest and the mean one of its n-grams."""
    word, gram = tables
    most, total = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
    for flat, have, begin in found:
        if len(have):
            x = gram[flat]
            most[have] = np.maximum(most[have], np.maximum.reduceat(x, begin))
            total[have] += np.add.reduceat(x, begin)
    own = np.fromiter((word.get(w, 0.0) for w in words), np.float32, len(words))
    return np.stack((own, most, total / gram_counts(found, len(words)).astype(np.float32)), axis=1)


class Network:
    """Weights, forward pass and gradients. Shapes: B windows, T steps, H hidden units per direction."""

    def __init__(self, vocabulary: dict[str, int], hidden: int = 8, word_dim: int = 8, char_dim: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.h = vocabulary, hidden
        x = 3 + word_dim + char_dim
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": np.vstack((0.1 * draw(len(vocabulary), word_dim) if vocabulary else np.zeros((0, word_dim), np.float32),
                                     np.zeros((1, word_dim), np.float32))),
                  "char": (0.1 * rng.standard_normal((BUCKETS, char_dim))).astype(np.float32),
                  "A": draw(2 * hidden, hidden), "a": np.zeros(hidden, np.float32), "v": draw(hidden),
                  "u": draw(2 * hidden), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(x, 3 * hidden), f"U{d}": draw(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def word_vectors(self, words: Sequence[str], found, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words + 1, x): input of each word; the last row is for places beyond the end. And the words' vocabulary rows."""
        known = np.fromiter((self.vocabulary.get(w, len(self.vocabulary)) for w in words), np.int64, len(words))
        char = np.zeros((len(words), self.p["char"].shape[1]), np.float32)
        for flat, have, begin in found:
            if len(have):
                char[have] += np.add.reduceat(self.p["char"][flat], begin, axis=0)
        char /= gram_counts(found, len(words))[:, None].astype(np.float32)
        x = np.hstack((odds, self.p["word"][known], char))
        return np.vstack((x, np.zeros((1, x.shape[1]), np.float32))), known

    def _gru(self, xw: np.ndarray, windows: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (T, B, H) of one direction, and what the gradient needs."""
        n, h, u = self.h, np.zeros((len(windows), self.h), np.float32), self.p[f"U{d}"]
        out, cache = np.zeros((WINDOW, len(windows), n), np.float32), []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            hu, x, m = h @ u, xw[windows[:, t]], mask[:, t:t + 1]
            zr = sigmoid(x[:, :2 * n] + hu[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(x[:, 2 * n:] + r * hu[:, 2 * n:])
            if keep:
                cache.append((t, h, z, r, new, hu[:, 2 * n:], m))
            h = h + m * ((1 - z) * (new - h))
            out[t] = h
        return out, cache

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logit of each window."""
        mask = (windows >= 0).astype(np.float32)
        (f, cf), (b, cb) = (self._gru(vectors @ self.p[f"W{d}"] + self.p[f"b{d}"], windows, mask, d, keep) for d in "fb")
        states = np.concatenate((f, b), axis=2)
        e = np.tanh(states @ self.p["A"] + self.p["a"])
        s = np.where(mask.T > 0, e @ self.p["v"], -1e9)
        w = np.exp(s - s.max(axis=0)) * np.maximum(mask.T, 1e-9)
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        logit = pooled @ self.p["u"] + self.p["c"][0]
        return (logit, (mask, states, e, w, pooled, cf, cb)) if keep else logit

    def gradients(self, words, found, odds, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy."""
        vectors, known = self.word_vectors(words, found, odds)
        logit, (mask, states, e, w, pooled, cf, cb) = self.forward(vectors, windows, True)
        n, p = self.h, self.p
        g = {k: np.zeros_like(x) for k, x in p.items()}
        d = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g["u"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["u"]
        dw = np.einsum("bh,tbh->tb", dp, states)
        ds = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", states, de), de.sum(axis=(0, 1))
        dstates = w[:, :, None] * dp + de @ p["A"].T
        dv = np.zeros_like(vectors)
        for name, cache, own in (("f", cf, dstates[:, :, :n]), ("b", cb, dstates[:, :, n:])):
            u, dxw = p[f"U{name}"], np.zeros((len(vectors), 3 * n), np.float32)
            later = np.zeros((len(windows), n), np.float32)
            for t, h, z, r, new, hn, m in reversed(cache):
                dh = own[t] + later
                dm = dh * m
                dz = dm * (h - new) * z * (1 - z)
                dn = dm * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                np.add.at(dxw, windows[:, t], np.hstack((dz, dr, dn)))
                back = np.hstack((dz, dr, dn * r))
                g[f"U{name}"] += h.T @ back
                later = dh * (1 - m) + dm * z + back @ u.T
            dxw[-1] = 0
            g[f"W{name}"], g[f"b{name}"] = vectors.T @ dxw, dxw.sum(axis=0)
            dv += dxw @ p[f"W{name}"].T
        wide = p["word"].shape[1]
        np.add.at(g["word"], known, dv[:-1, 3:3 + wide])
        g["word"][-1] = 0
        dchar = dv[:-1, 3 + wide:] / gram_counts(found, len(words))[:, None].astype(np.float32)
        for flat, have, begin in found:
            np.add.at(g["char"], flat, np.repeat(dchar[have], np.diff(np.concatenate((begin, [len(flat)]))), axis=0))
        return g


@dataclass
class Model:
    network: Network
    odds: tuple[dict[str, float], np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: Sequence[str], batch: int = 4096) -> np.ndarray:
        """The largest logit of each text's windows."""
        t = windows_of(texts)
        found = grams(t.words)
        vectors, _ = self.network.word_vectors(t.words, found, odds_features(t.words, found, self.odds))
        each = np.concatenate([self.network.forward(vectors, t.windows[i:i + batch]) for i in range(0, len(t.windows), batch)])
        return np.maximum.reduceat(each, np.searchsorted(t.of, np.arange(len(texts))))

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        return sigmoid(self.slope * (self.logits(texts).astype(np.float64) - self.shift) + np.log(0.7 / 0.3))


def _subset(words: Sequence[str], windows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words that some windows use, their numbers, and the windows in numbers of these."""
    used = np.unique(windows[windows >= 0])
    renamed = np.full(len(words) + 1, -1)
    renamed[used] = np.arange(len(used))
    return [words[i] for i in used.tolist()], used, np.where(windows >= 0, renamed[windows], -1)


def train(texts: Sequence[str], labels: np.ndarray, share: float, *, epochs: int = 5, steps: int = 300, batch: int = 128, rate: float = 0.01,
          seed: int = 0) -> Model:
    """``share``: of toxic rows among all labelled ones, for the threshold. More epochs if they make fewer than ``steps``."""
    rng = np.random.default_rng(seed)
    t = windows_of(texts)
    found = grams(t.words)
    first = np.searchsorted(t.of, np.arange(len(texts) + 1))
    fold = np.zeros(len(texts), np.int64)
    for c in (0, 1):  # both classes in both halves
        own = np.flatnonzero(labels == c)
        fold[rng.permutation(own)] = np.arange(len(own)) % 2
    halves, whole, counts = (Odds(), Odds()), Odds(), Counter()
    for d in range(len(texts)):
        numbers = np.unique(t.windows[first[d]:first[d + 1]])
        words = [t.words[i] for i in numbers[numbers >= 0].tolist()]
        counts.update(words)
        for o in (halves[1 - fold[d]], whole):
            o.add(words, int(labels[d]))
    often = sorted(w for w, n in counts.items() if n >= 5)
    network = Network({w: i for i, w in enumerate(often)}, seed=seed)
    odds = [odds_features(t.words, found, h.tables()) for h in halves]
    window_fold = fold[t.of]
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in network.p.items()}
    step = 0

    def all_logits() -> np.ndarray:
        out = np.zeros(len(t.windows), np.float32)
        for k in (0, 1):
            vectors, _ = network.word_vectors(t.words, found, odds[k])
            for i in range(0, len(t.windows), 4096):
                rows = np.flatnonzero(window_fold[i:i + 4096] == k) + i
                if len(rows):
                    out[rows] = network.forward(vectors, t.windows[rows])
        return out

    # before the first epoch, the highest window is the one with the highest log odds
    padded = [np.append(o[:, 0] + o[:, 1], 0) for o in odds]
    logit = np.array([np.sort(padded[k][w])[-3:].sum() for k, w in zip(window_fold.tolist(), t.windows, strict=True)])
    n_chosen = len(texts) + int((labels == 0).sum())
    epochs = max(epochs, -(-steps * batch // (2 * n_chosen)))
    for epoch in range(epochs):
        top = np.array([first[d] + logit[first[d]:first[d + 1]].argmax() for d in range(len(texts))])
        other = np.array([rng.integers(first[d], first[d + 1]) for d in np.flatnonzero(labels == 0).tolist()], np.int64)
        chosen = rng.permutation(np.unique(np.concatenate((top, other))))
        for i in range(0, len(chosen), batch):
            for k in (0, 1):
                rows = chosen[i:i + batch][window_fold[chosen[i:i + batch]] == k]
                if not len(rows):
                    continue
                words, used, windows = _subset(t.words, t.windows[rows])
                y = labels[t.of[rows]].astype(np.float32)
                weight = np.where(y == 1, 0.5 / max((labels == 1).mean(), 1e-6), 0.5 / max((labels == 0).mean(), 1e-6)).astype(np.float32)
                g = network.gradients(words, grams(words), odds[k][used], windows, y, weight)
                step += 1
                slow = rate * (1 if epoch < epochs - 2 else 0.3)
                for name, x in network.p.items():  # Adam; embeddings learn slower, or they learn single texts by heart
                    now = slow * (EMBEDDING_RATE if name in ("word", "char") else 1)
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.001 * (g[name] ** 2 - v)
                    x -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        logit = all_logits()
    best = np.maximum.reduceat(logit, first[:-1])
    weight = np.where(labels == 1, share / max((labels == 1).mean(), 1e-6), (1 - share) / max((labels == 0).mean(), 1e-6))
    order = np.argsort(-best)
    hit, said = np.cumsum((weight * labels)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (said + (weight * labels).sum())
    cut = int(f1.argmax())
    shift = (best[order[cut]] + best[order[min(cut + 1, len(order) - 1)]]) / 2
    return Model(network, whole.tables(), 1.0, float(shift))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
        max_rows: int = 2500, max_chars: int = 20_000, seed: int = 0) -> Model | None:
    """The model from labelled rows that are not held out; None without both classes."""
    known = labels.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1) & (F.crc32(F.col("_lid").cast("string").cast("binary")) % 3 != 1))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).filter(F.length("_text") <= max_chars)
    order = F.xxhash64(F.lit(seed), "_lid")
    picked = None
    for c in (0, 1):
        # some more than wanted, as some are too long
        own = known.filter(F.col("_label") == c).orderBy(order, "_lid").limit(2 * max_rows)
        picked = own if picked is None else picked.unionByName(own)
    rows = (texts.join(F.broadcast(picked), F.col("_id") == F.col("_lid"))  # at most 4 * max_rows rows of two numbers
            .select("_label", order.alias("_r"), "_text"))
    parts = [rows.filter(F.col("_label") == c).orderBy("_r", "_text").limit(max_rows) for c in (0, 1)]
    got = parts[0].unionByName(parts[1]).toPandas().sort_values(["_r", "_text"])
    y = got["_label"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return train(got["_text"].tolist(), y, sizes[1] / (sizes[0] + sizes[1]), seed=seed)


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *,
             threshold: float = 0.7, block_chars: int = 2_000_000) -> DataFrame:
    """One row per document: id, score, predicted."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    kind = df.schema["_id"].dataType.simpleString()
    if model is None:
        return df.select(F.col("_id").alias(id_col), F.lit(0.5).cast("double").alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: embeddings, log odds and a word list of bounded rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, begin, held, parts = batch.column(1).to_pylist(), 0, 0, []
            for i, t in enumerate(texts):
                if i > begin and held + len(t) > block_chars:
                    parts.append(own.scores(texts[begin:i]))
                    begin, held = i, 0
                held += len(t)
            if texts:
                parts.append(own.scores(texts[begin:]))
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    return df.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
