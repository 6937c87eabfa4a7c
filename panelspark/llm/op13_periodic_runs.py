"""Periodic runs of words: seeds on diagonals of a text's own k-grams, extended both ways.

A run is a stretch of words with smallest period q and at least ``max(min_length, min_exponent * q)`` words that no
neighbouring word extends. On the diagonal of lag q (word i beside word i + q) it is a stretch of equal pairs that
is q shorter than the run. Lags are taken in bands [2^b, 2^(b+1)); the shortest such stretch in a band is the
overlap that every run of the band is sure to have, and the k of the band.

* Index: the k-grams of a text, numbered exactly (no hashes) from two overlapping grams of the largest power of two,
  these by doubling. A gram that occurs once in its text is dropped and so is every longer gram on it.
* Occurrence pairs: k is at least q, so inside a run a gram's next occurrence is exactly q words on (two periods
  on one stretch of q + k words would give it a smaller one). Pairs of neighbouring occurrences are thus
  enough: there are fewer than words, however often a gram occurs, and their lag is the smallest period.
* Extension: a pair whose lag lies in the band is extended left and right along its diagonal. The table of the furthest
  word covered on each lag skips every later pair of the same stretch.

Scale: rows are independent, so there is no shuffle; a task holds ``block_bytes`` of text, or one text if it is longer.
The pairs extended are runs of exponent over 2.5, whose number is below the words of the text and whose lengths sum to
O(n log n), so a text of one word repeated costs as little as any other.

Edge cases: a null text has no words; a null id is an id; repeated rows get equal results and stay repeated; an empty
table gives an empty result; texts of any length are read whole; ties of the best run go to the smallest start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_blocks import split_words, text_blocks
from .common import SPACE, text_of

Run = tuple[int, int, int]  # start, length, period


def guaranteed_overlap(band: int, min_length: int, min_exponent: int) -> int:
    """Equal pairs on its diagonal that every run with a period in [2^band, 2^(band+1)) has at least."""
    low, high = 1 << band, (2 << band) - 1
    turn = min(max(low, min_length // min_exponent + 1), high)  # from here on longer periods have longer stretches
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(low, turn + 1))


def _numbered(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair, equal for equal pairs, and which pairs occur twice or more."""
    if not len(left):
        return left, np.zeros(0, bool)
    _, number, count = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True, return_counts=True)
    return number, count[number] > 1


def _joined(at: np.ndarray, gram: np.ndarray, shift: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers of the grams made of one at i and one at i + shift of the same text, repeated ones only."""
    to = np.searchsorted(at, at + shift)
    found = to < len(at)
    found[found] = at[to[found]] == at[found] + shift
    found[found] = text[at[found]] == text[at[found] + shift]
    number, again = _numbered(gram[found], gram[to[found]])
    return at[found][again], number[again]


def _reach(words: np.ndarray, at: int, lag: int, end: int, step: int) -> int:
    """How many pairs in a row are equal from ``at`` on and before ``end`` (``step`` 1), or before ``at`` down to ``end`` (-1)."""
    done, chunk = 0, 16
    left = (end - at) * step
    while done < left:
        n = min(chunk, left - done)
        a = at + done if step > 0 else at - done - n
        same = words[a:a + n] == words[a + lag:a + lag + n]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, chunk = done + n, 2 * chunk
    return done


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, Run]]:
    """(text number, run) of all runs; ``words``: numbers of the words of texts laid end to end, ``sizes`` words each."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of 3 and a length of 2 at least")
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    number, again = _numbered(text, words.astype(np.int64))
    at = np.flatnonzero(again)
    gram, size = number[again], 1
    out: list[tuple[int, Run]] = []
    longest = int(sizes.max(initial=0))
    band = 0
    while len(at) and max(min_length, min_exponent << band) <= longest:
        k = guaranteed_overlap(band, min_length, min_exponent)
        while 2 * size <= k:
            at, gram = _joined(at, gram, size, text)
            size *= 2
        seeds, key = (at, gram) if size == k else _joined(at, gram, k - size, text)
        by = np.lexsort((seeds, key))
        first, second = seeds[by][:-1], seeds[by][1:]
        lag = second - first
        taken = (key[by][1:] == key[by][:-1]) & (lag >= 1 << band) & (lag < 2 << band)
        first, lag = first[taken], lag[taken]
        by = np.lexsort((first, lag))
        first, lag = first[by], lag[by]
        # a pair right behind another of its lag is covered by that one's extension
        head = np.ones(len(first), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(first[head].tolist(), lag[head].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            t = int(text[i])
            start = i - _reach(words, i, q, int(begins[t]), -1)
            covered[q] = end = i + _reach(words, i, q, int(ends[t]) - q, 1)
            length = end + q - start
            if length >= max(min_length, min_exponent * q):
                out.append((t, (start - int(begins[t]), length, q)))
        band += 1
    out.sort(key=lambda x: (x[0], x[1][0], x[1][2]))
    return out


def kept_words(sizes: np.ndarray, runs: list[tuple[int, Run]]) -> np.ndarray:
    """Which of the texts' words are not in a run after its first period."""
    begins = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    for t, (start, length, period) in runs:
        edge[begins[t] + start + period] += 1
        edge[begins[t] + start + length] -= 1
    return np.cumsum(edge)[:-1] == 0


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6,
                  min_exponent: int = 4, block_bytes: int = 4_000_000) -> DataFrame:
    """One row per document: id, n_words, runs (by start, then period), best (the run with the greatest length / period,
    null without runs), collapsed_text (the words that no run holds after its first period, joined by blanks)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    run_type = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def rows_of(block: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = split_words(block.column("_text"), SPACE + "+")
        words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = find_runs(words, sizes, min_length, min_exponent)
        kept = kept_words(sizes, runs)
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        offsets = pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(pa.array(kept)).cast(pa.string())), " ")
        own: list[list[dict]] = [[] for _ in sizes]
        for t, run in runs:
            own[t].append(dict(zip(("start", "length", "period"), run, strict=True)))
        best = [max(x, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if x else None for x in own]
        return pa.RecordBatch.from_arrays(
            [block.column("_id"), pa.array(sizes), pa.array(own, pa.list_(run_type)), pa.array(best, run_type), texts],
            names=[id_col, "n_words", "runs", "best", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "_text", block_bytes):
            yield rows_of(block)

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed_text string")
