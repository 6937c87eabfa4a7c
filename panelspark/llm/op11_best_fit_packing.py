"""Best-fit packing of whole documents, after a Martello-Toth dominance reduction.

A document's ids, closed by the end id, are one item; only a document longer than a sequence is cut, into full sequences
and a first piece with what is over. All documents are one instance, not groups of them: what the packing depends on
is how many pieces have each length, at most ``room`` counts however large the corpus, so the plan is made once from
that histogram and the pieces then look up their places.

* Reduction: by decreasing length, a set of one to three pieces is fixed as a sequence of its own, as often as
  the counts allow, when it provably dominates every other set with its longest piece j:
  j alone, if nothing fits beside it; j and the longest fitting piece, if they fill the sequence, if no two others fit, or
  if that piece is as long as any two that fit; j, the longest fitting piece and the longest that fits beside both, if no
  three others fit and any fitting pair has its shorter piece no longer than the third. What a dominated set holds
  can change places with the set's pieces in any packing, so a smallest packing remains possible. Fixed pieces leave the
  instance, which may let further sets dominate; this goes on until none does.
* Best fit: the rest by decreasing length, each piece into the sequence with the least room that holds it. Sequences
  with equal room are kept as ranges, so a step places all pieces of one length in one range at once.

Scale: one pass writes the pieces' ids to the shared folder, each with its rank among the pieces of its length in its
task. Counts per (task, length) are turned into rank offsets by a running sum (one row per task and length), so a length that
a third of all documents share is never counted in one task. The plan on the driver has at most ``room`` counts in and, as a
sequence holds at most sqrt(2 * room) different lengths, a bounded number of ranges out. The pieces meet their offset
in one join on (task, length), whose keys hold no more rows than a task read; up to ``broadcast_counts`` offsets are
broadcast, more are merged (one shuffle of the ids). A lost task writes its ranks anew; only those
of the committed file are read.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; equal lengths are ranked by task and
place; a null id is an id; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_blocks import text_blocks
from .bpe_files import WORDS, BpeFile
from .common import stage, text_of
from .op07_packing import fast_encoder


class Slots(NamedTuple):
    """The pieces of one length with ranks first..first+count-1: ``each`` of them, one behind the other from ``offset``,
    go into each of the sequences from ``sequence`` on."""
    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


class Instance:
    """Pieces still to be placed, as counts by length, and the slots of those that are."""

    def __init__(self, counts: dict[int, int], room: int):
        self.room, self.left = room, {s: n for s, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.rank, self.slots, self.sequences = Counter(), [], 0

    def place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.slots.append(Slots(length, self.rank[length], count, each, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.remove(length)

    def fix(self, pieces: tuple[int, ...]) -> None:
        """This set as sequences of their own, as often as there are pieces for it."""
        of = Counter(pieces)
        times = min(self.left[s] // n for s, n in of.items())
        offset = 0
        for s, n in of.items():
            self.place(s, times * n, n, self.sequences, offset)
            offset += s * n
        self.sequences += times

    # --- what is left beside one piece ------------------------------------------------------

    def smallest(self, without: Counter, above: int, most: int) -> list[int]:
        """The ``most`` shortest pieces longer than ``above``, but for one set of pieces."""
        out: list[int] = []
        for s in self.lengths[bisect_left(self.lengths, above + 1):]:
            out += [s] * min(most - len(out), self.left[s] - without[s])
            if len(out) == most:
                break
        return out

    def longest(self, without: Counter, fits: int) -> int:
        """The longest piece of at most ``fits``, but for one set of pieces; 0 if there is none."""
        at = bisect_left(self.lengths, fits + 1) - 1
        while at >= 0 and self.left[self.lengths[at]] <= without[self.lengths[at]]:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def longest_pair(self, without: Counter, fits: int) -> int:
        """The greatest sum of two pieces that is at most ``fits``."""
        best = 0
        for a in reversed(self.lengths[:bisect_left(self.lengths, fits)]):
            if 2 * a <= best:
                break
            if self.left[a] > without[a]:
                b = self.longest(without + Counter((a,)), min(a, fits - a))
                best = max(best, a + b if b else 0)
        return best

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """A set with a piece of length ``j`` that dominates all others with it, if one of the rules finds it."""
        fits, own = self.room - j, Counter((j,))
        least = np.cumsum(self.smallest(own, 0, 3))
        beside = int((least <= fits).sum())  # so many others fit at most; 3 stands for more
        if not beside:
            return (j,)
        a = self.longest(own, fits)
        if beside == 1 or a == fits:
            return j, a
        if beside == 2:
            if a >= self.longest_pair(own, fits):
                return j, a
            b = self.longest(own + Counter((a,)), fits - a)
            over = self.smallest(own, b, 2)
            if b and (len(over) < 2 or sum(over) > fits):
                return j, a, b
        return None

    def reduce(self) -> None:
        """Fix dominating sets until no rule finds another."""
        found = True
        while found:
            found = False
            for j in self.lengths[::-1]:
                while self.left.get(j) and (pieces := self.dominating(j)):
                    self.fix(pieces)
                    found = True

    def best_fit(self) -> None:
        """Place all that is left, longest first, where the least room is left."""
        rooms: list[int] = []  # ascending
        ranges: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence, how many

        def keep(room: int, sequence: int, count: int) -> None:
            if room and count:
                if room not in ranges:
                    insort(rooms, room)
                ranges.setdefault(room, []).append((sequence, count))

        for s in self.lengths[::-1]:
            while count := self.left.get(s, 0):
                at = bisect_left(rooms, s)
                if at == len(rooms):
                    room, sequence, many = self.room, self.sequences, -(-count // (self.room // s))
                    self.sequences += many
                else:
                    room = rooms[at]
                    sequence, many = ranges[room].pop()
                    if not ranges[room]:
                        del ranges[room]
                        del rooms[at]
                each = room // s
                full = min(many, count // each)
                if full:
                    self.place(s, full * each, each, sequence, self.room - room)
                    keep(room - each * s, sequence, full)
                if full < many and (over := count - full * each):
                    self.place(s, over, over, sequence + full, self.room - room)
                    keep(room - over * s, sequence + full, 1)
                    full += 1
                keep(room, sequence + full, many - full)


def plan(counts: dict[int, int], room: int) -> list[Slots]:
    """Slots for all pieces of the lengths counted."""
    todo = Instance(counts, room)
    todo.reduce()
    todo.best_fit()
    return todo.slots


PIECE = "piece int, start bigint, length bigint, ids binary, _task int, _rank bigint"
RANKS = 1 << 45  # more than pieces of one length


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, room: int = 2048,
                  end_id: int = 0, pattern: str = WORDS, block_bytes: int = 4_000_000) -> DataFrame:
    """One row per piece: _id, piece, start, length, ids (little-endian unsigned 32-bit integers), _task, _rank (among the
    task's pieces of that length)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = BpeFile.load(tokenizer, pattern)
        encoder, to_id = fast_encoder(spec)
        added, end, task = tuple(spec.added), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        seen = [0] * (room + 1)

        def encode(text: str) -> np.ndarray:
            if any(t in text for t in added):
                own = np.array(encoder.encode(text, allowed_special="all"), np.int64)
            else:
                own = encoder.encode_to_numpy(text, disallowed_special=())
            return np.concatenate((to_id[own], end))

        for block in text_blocks(batches, "_text", block_bytes):
            rows = []
            for d, text in enumerate(block.column("_text")):
                ids = encode(text.as_py())
                cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((d, k, a, b - a, ids[a:b].tobytes(), task, seen[b - a]))
                    seen[b - a] += 1
            d, *columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [block.column("_id").take(pa.array(d)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["_id", "piece", "start", "length", "ids", "_task", "_rank"])

    return df.mapInArrow(run, f"_id {df.schema['_id'].dataType.simpleString()}, {PIECE}")


def pack_whole_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, room: int = 2048,
                         end_id: int = 0, pattern: str = WORDS, broadcast_counts: int = 250_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids, sequence_id, offset. ``tokenizer``: path of the file, the
    same on all machines; ids are those of the tokenizers library with it."""
    pieces = stage(cut_documents(docs, tokenizer, id_col, text_col, room=room, end_id=end_id, pattern=pattern), "op11-pieces")
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "op11-counts")
    lengths = cells.groupBy("length").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("cells")).collect()
    few = sum(r.cells for r in lengths) <= broadcast_counts
    slots = np.array(sorted(plan({r.length: r.n for r in lengths}, room)), np.int64).reshape(-1, len(Slots._fields))
    keys = slots[:, 0] * RANKS + slots[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own = slots[np.searchsorted(keys, length.to_numpy() * RANKS + rank.to_numpy(), "right") - 1]
        nth = rank.to_numpy() - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 4] + nth // own[:, 3],
                             "offset": own[:, 5] + nth % own[:, 3] * own[:, 0]})

    placed = pieces.join(cells.drop("_n").hint("broadcast" if few else "merge"), ["_task", "length"]).withColumn("_at", place("length", F.col("_rank") + F.col("_before")))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids", "_at.sequence_id", "_at.offset")
