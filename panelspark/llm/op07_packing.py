"""Packing documents into token sequences: first-fit decreasing in randomised groups.

Documents are dealt to tasks by a hash, put into hash order and cut into groups of ``group_tokens``;
each group is packed on its own. A document's ids, closed by the end id, are cut into full sequences; what
is left over is an item. Items are taken by decreasing size, each goes to the first bin with room, found in
a tournament tree over the bins' free room (the inner nodes hold the larger room below). Then the emptiest bins
are emptied into the gaps of the fullest ones, cut to fit, as a document may be cut freely: gaps of
``min_gap`` ids or more are filled as long as bins are left to empty.

Scale: one shuffle of the texts, by a hash of id and text, so no key is hot; a task holds one group at a time.
Order and group depend on the rows only, so a task that runs again gives the same rows. Sequence numbers hold
the partition's number.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an
empty result; a text longer than a group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_files import WORDS, BpeFile
from .common import text_of

Piece = tuple[int, int, int]  # item (a document of the group), start, length


class RoomTree:
    """Tournament tree of the free room of bins 0, 1, 2...; all bins start with ``room``."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [room] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; the bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        found = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return found


def first_fit_decreasing(items: list[Piece], room: int) -> list[list[Piece]]:
    """Bins of pieces; by decreasing length, ties as they come."""
    tree = RoomTree(len(items), room)
    bins: list[list[Piece]] = []
    for item in sorted(items, key=lambda x: -x[2]):
        b = tree.put(item[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
    return bins


def fill_gaps(bins: list[list[Piece]], room: int, min_gap: int) -> list[list[Piece]]:
    """Empty the emptiest bins into the gaps of the others, cutting pieces to fit."""
    used = {i: sum(x[2] for x in b) for i, b in enumerate(bins)}
    order = sorted(used, key=lambda i: (-used[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        to, source = order[low], order[high]
        gap = room - used[to]
        if gap < min_gap:
            low += 1
            continue
        doc, start, length = bins[source].pop()
        take = min(gap, length)
        bins[to].append((doc, start, take))
        used[to] += take
        used[source] -= take
        if take < length:
            bins[source].append((doc, start + take, length - take))
        if not bins[source]:
            high -= 1
    return [b for b in bins if b]


def pack(lengths: list[int], room: int, min_gap: int = 8) -> list[list[Piece]]:
    """Sequences of pieces of at most ``room`` ids for documents of these lengths."""
    full = [[(d, s, room)] for d, n in enumerate(lengths) for s in range(0, n - room + 1, room)]
    rest = [(d, n - n % room, n % room) for d, n in enumerate(lengths) if n % room]
    return full + fill_gaps(first_fit_decreasing(rest, room), room, min_gap)


def fast_encoder(spec: BpeFile) -> tuple[tiktoken.Encoding, np.ndarray]:
    """An encoder with the file's merges, and what its ranks are as ids of the file."""
    order = [bytes([b]) for b in range(256)] + [spec.pieces[m] for _, _, m in spec.merges]
    ranks = {p: r for r, p in enumerate(order)}
    if len(ranks) != len(order):
        raise ValueError("two merges give the same piece; this file needs the pair index encoder")
    special = {t: len(order) + i for i, t in enumerate(spec.added)}
    to_id = np.array(spec.bytes_to_id + [m for _, _, m in spec.merges] + list(spec.added.values()), np.uint32)
    return tiktoken.Encoding("file", pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens=special), to_id


OUT = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, room: int = 1024,
                   end_id: int = 0, min_gap: int = 8, group_tokens: int = 4_000_000, pattern: str = WORDS,
                   seed: int = 7) -> DataFrame:
    """One row per piece: id, start, length, ids (its ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset. ``tokenizer``: path of the file, the same on all machines. Ids are those of the tokenizers
    library with that file (tested); the encoder used is the faster one of tiktoken with the file's merges.

    Padding, when sequences are made up, is ``room`` less the sequence's ids, or none at a power of two."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    df = df.withColumn("_r", F.xxhash64(F.lit(seed), "_id", "_text"))
    df = df.repartition("_r").sortWithinPartitions("_r", "_id").drop("_r")
    kind = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = BpeFile.load(tokenizer, pattern)
        encoder, to_id = fast_encoder(spec)
        added, end, number = set(spec.added), np.array([end_id], np.uint32), TaskContext.get().partitionId() << 40

        def encode(text: str) -> np.ndarray:
            if any(t in text for t in added):
                own = np.array(encoder.encode(text, allowed_special="all"), np.int64)
            else:
                own = encoder.encode_to_numpy(text, disallowed_special=())
            return np.concatenate((to_id[own], end))

        def packed(keys: list, group: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in pack([len(x) for x in group], room, min_gap):
                at = 0
                for d, start, n in pieces:
                    rows.append((d, start, n, group[d][start:start + n].tobytes(), len(group[d]), number, at))
                    at += n
                number += 1
            d, *columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            ids = pa.concat_arrays(keys).take(pa.array(d))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                              names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        keys, group, held = [], [], 0
        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(1)):
                own = encode(text.as_py())
                if group and held + len(own) > group_tokens:
                    yield packed([*keys, batch.column(0).slice(begin, i - begin)], group)
                    keys, group, held, begin = [], [], 0, i
                group.append(own)
                held += len(own)
            keys.append(batch.column(0).slice(begin))
        if group:
            yield packed(keys, group)

    return df.mapInArrow(run, f"`{id_col}` {kind}, {OUT}")
