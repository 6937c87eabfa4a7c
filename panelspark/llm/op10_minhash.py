"""MinHash near-dedup: many universal hash minima, bands, verification, connected components.

1. *Sketch* (numpy inside tasks). A text's set is its distinct ``shingle``-word shingles as 64-bit hashes. Texts with
   equal sets are one *node*, named by a hash of the set, so a group of copies is one node from here on.
   ``bands * rows`` universal hashes ``(a x + b) mod 2^64`` give minima; each band of ``rows`` minima is a key. Two
   sets of similarity s miss each other in all bands with (1 - s^rows)^bands: 5e-6 at 0.75 for 32 bands of 4.
2. *First candidates.* Each key's smallest and largest node (aggregated before the shuffle) are paired with
   its other nodes: a star, not all pairs.
3. *Verification.* Signatures of a pair must agree well enough to be near the threshold (five standard deviations of
   slack); what passes is decided exactly on the full sets. Sets are computed again for candidate nodes only.
4. *Components* by alternating large-star and small-star on the links.
5. *The rest.* A key with four nodes or more that lie in different components may hide links between them (up to
   three nodes, the star had all pairs). Such a key's nodes outside its largest component are compared with all
   its nodes, block against block of ``block`` nodes: a task holds two blocks, compares signatures as arrays, then sets,
   and returns links only. A pair is taken at its first shared key only, and not if its two components
   have met already in that task. So no link between different texts that share a key is lost, and no pair within a
   component is looked at.

Scale: all steps are groupings with map-side partial aggregation and equi-joins that adaptive execution can split;
nodes, links and components never reach the driver (only counts do). Each iteration is written to the
shared folder.

Edge cases: a null or empty text, or one without words, has an empty set and is a component of its own; a text
with fewer words than a shingle is one shingle; rows that repeat are copies; with null ids the
smallest non-null id names the component, if there is one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

U64 = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit depends on every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def shingle_set(text: str, shingle: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. Words are split at ASCII white space; only A-Z are lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, U64)
    h = np.fromiter(map(words.__getitem__, found), U64, len(found))
    n = min(shingle, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, U64(n))
        for j in range(n):
            out = _mix(out * U64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j])
    return np.unique(out)


class Sketcher:
    def __init__(self, shingle: int, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shingle, self.bands, self.rows, self.words = shingle, bands, rows, _WordHashes()
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=U64)[:, None] * U64(2) + U64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=U64)[:, None]
        self.salt = _mix(rng.integers(0, 1 << 63, bands, dtype=U64))

    def set(self, text: str) -> np.ndarray:
        return shingle_set(text, self.shingle, self.words)

    def minima(self, found: np.ndarray) -> np.ndarray:
        """The upper 32 bits of each hash's minimum over the set, in blocks of the set."""
        x = found >> U64(32)
        out = np.full(len(self.a), U64(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for i in range(0, len(x), 2048):
                h = self.a * x[i:i + 2048]
                h += self.b
                np.minimum(out, h.min(axis=1), out=out)
        return (out >> U64(32)).astype(np.uint32)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(self.bands, self.rows).astype(U64)
        out = self.salt
        with np.errstate(over="ignore"):
            for j in range(self.rows):
                out = _mix(out * U64(0x9E3779B97F4A7C15) + parts[:, j])
        return out.astype(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """_id, _ck (text hash), n (set size), node and twin (two hashes of the set, null if empty), keys."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).withColumn("_ck", F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle, bands, rows, seed)
        for batch in batches:
            out = []
            for text in batch.column(1):
                s = sketcher.set(text.as_py())
                if len(s):
                    raw = s.tobytes()
                    name, twin = (np.frombuffer(xxhash.xxh3_128_digest(raw, seed), np.int64)).tolist()
                    out.append((len(s), name, twin, sketcher.keys(sketcher.minima(s))))
                else:
                    out.append((0, None, None, np.zeros(0, np.int64)))
            n, node, twin, keys = zip(*out, strict=True) if out else ((), (), (), ())
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["_id", "_ck", "n", "node", "twin", "keys"])

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"_id {kind}, _ck bigint, n bigint, node bigint, twin bigint, keys array<bigint>")


def told_apart(sketch: DataFrame) -> DataFrame:
    """``sketch`` with nodes that name one set each. Of n sets some n^2 / 2^65 pairs share a 64-bit name (11 at 2 * 10^10);
    their rows differ in the twin and get a new name from both, until no name is left twice. So sets are one only if
    128 bits agree."""
    salt = 0
    while True:
        clash = (sketch.filter("node is not null").groupBy(F.col("node").alias("c_node"))
                 .agg(F.min("twin").alias("p"), F.max("twin").alias("q")).filter("p != q").select("c_node"))
        if clash.isEmpty():
            return sketch
        salt += 1
        other = F.when(F.col("c_node").isNotNull(), F.xxhash64(F.lit(salt), "node", "twin")).otherwise(F.col("node"))
        sketch = stage(sketch.join(clash, F.col("node") == F.col("c_node"), "left").withColumn("node", other).drop("c_node"), "op10-sketch")


def node_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """node, sig (minima), shingles (the set), short (lower halves of its hashes, sorted), for ``chosen`` (node, r_id, r_ck: a row that has the node's set)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).withColumn("_ck", F.xxhash64("_text"))
    df = df.join(chosen, F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_ck") == F.col("r_ck"))).select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle, bands, rows, seed)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [sketcher.set(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([sketcher.minima(s).tobytes() for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([np.sort(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())],
                    names=["node", "sig", "shingles", "short"])

    # a repeated row brings its node again
    return df.mapInArrow(run, "node bigint, sig binary, shingles binary, short binary").dropDuplicates(["node"])


def _pairs_where(pairs: DataFrame, of: DataFrame, column: str, test) -> DataFrame:
    """The (a, b) of ``pairs`` for which ``test(bytes of a, bytes of b)`` holds, with ``column`` of ``of`` (node, column)."""
    x = of.select(F.col("node").alias("x_node"), F.col(column).alias("x"))
    y = of.select(F.col("node").alias("y_node"), F.col(column).alias("y"))
    both = (pairs.join(x, F.col("a") == F.col("x_node")).select("a", "b", "x")
            .join(y, F.col("b") == F.col("y_node")).select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [test(p.as_buffer(), q.as_buffer()) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, minima: int) -> DataFrame:
    """Links (a, b) among ``pairs``: near by signature, then at least ``percent`` by the full sets."""
    s = percent / 100
    least = max(0, int(minima * (s - 5 * (s * (1 - s) / minima) ** 0.5)))

    def near(p, q) -> bool:
        return int((np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)).sum()) >= least

    def similar(p, q) -> bool:
        x, y = np.frombuffer(p, U64), np.frombuffer(q, U64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    likely = stage(_pairs_where(pairs, sets, "sig", near), "op10-likely")
    return _pairs_where(likely, sets, "shingles", similar)


def components(links: DataFrame, name: str = "op10-cc") -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node reachable.

    Alternates large-star and small-star until the links stay the same; then each node points to its smallest."""
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(df):
        """Per u, the smallest of its v."""
        return df.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))

    # u > v throughout
    now = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        large = (now.select(F.col("v").alias("u"), F.col("u").alias("v"))
                 .join(least(both), F.col("u") == F.col("m_u"))
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct())
        large = stage(large, name)
        # small star: u and its smaller neighbours go to the smallest of these
        small = large.join(least(large), F.col("u") == F.col("m_u"))
        small = (small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                 .filter("u != v").distinct())
        now = stage(small, name)
        if (new := state(now)) == seen:
            break
        seen = new
    return (now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())


def rest_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, bands: int, rows: int, seed: int,
               block: int) -> DataFrame:
    """Links (a, b) between components that share a key, found block against block. Sets are compared by the lower
    halves of their hashes, so what is returned, with a slack for chance matches, is to be verified on the full sets."""
    comps = comps.select(F.col("node").alias("c_node"), "comp")
    at = (members.select("key", "node").join(comps, F.col("node") == F.col("c_node"), "left")
          .select("key", "node", F.coalesce("comp", "node").alias("comp")))
    at = stage(at, "op10-at")
    sizes = at.groupBy("key", "comp").agg(F.count("*").alias("s"))
    keys = (sizes.groupBy(F.col("key").alias("o_key")).agg(F.sum("s").alias("m"), F.max(F.struct("s", "comp")).alias("main"))
            .filter((F.col("m") > 3) & (F.col("main.s") < F.col("m"))))
    at = at.join(keys, F.col("key") == F.col("o_key")).select(
        "key", "node", "comp", (F.col("comp") != F.col("main.comp")).alias("out"),
        F.ceil((F.col("m") - F.col("main.s")) / block).alias("n_left"), F.ceil(F.col("m") / block).alias("n_right"))
    at = at.join(sets.select(F.col("node").alias("s_node"), "sig", "short"), F.col("node") == F.col("s_node")).drop("s_node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    cols = ["key", "i", "j", "side", "node", "comp", "out", "sig", "short"]
    left = at.filter("out").withColumn("i", own("n_left")).withColumn("j", upto("n_right")).withColumn("side", F.lit(0)).select(cols)
    right = at.withColumn("j", own("n_right")).withColumn("i", upto("n_left")).withColumn("side", F.lit(1)).select(cols)
    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    s = percent / 100
    least = max(0, int(bands * rows * (s - 5 * (s * (1 - s) / (bands * rows)) ** 0.5)))

    def compare(sketcher: Sketcher, key: int, group: list[tuple]) -> Iterator[tuple[int, int]]:
        n_left = sum(r[0] == 0 for r in group)
        if not 0 < n_left < len(group):
            return
        sigs = np.array([np.frombuffer(r[4], np.uint32) for r in group])
        nodes, comp = np.array([r[1] for r in group]), [r[2] for r in group]
        out = np.array([r[3] for r in group])
        comp_of = np.array(comp)
        band = int(np.flatnonzero(sketcher.keys(sigs[0]) == key)[0])
        merged: dict[int, int] = {}

        def root(c: int) -> int:
            while c in merged:
                c = merged[c]
            return c

        for p in range(n_left):
            same = sigs[n_left:] == sigs[p]
            near = (same.sum(axis=1) >= least) & (comp_of[n_left:] != comp_of[p])
            near &= ~out[n_left:] | (nodes[n_left:] > nodes[p])  # of two outsiders each pair once
            for q in (np.flatnonzero(near) + n_left).tolist():
                if int(same[q - n_left].reshape(bands, rows).all(axis=1).argmax()) != band:
                    continue
                c, d = root(comp[p]), root(comp[q])
                if c == d:
                    continue
                x, y = np.frombuffer(group[p][5], np.uint32), np.frombuffer(group[q][5], np.uint32)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                all_of = len(x) + len(y) - both
                chance = len(x) * len(y) / 2 ** 32  # matches of lower halves alone, on average
                slack = 2 + int(4 * chance + 6 * chance ** 0.5)
                if 100 * (both - slack) >= percent * (all_of + slack):  # a link for sure
                    merged[c] = d
                if 100 * (both + slack) >= percent * (all_of - slack):
                    yield int(nodes[p]), int(nodes[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(0, bands, rows, seed)

        def links(group):
            return list(compare(sketcher, now[0], group))

        now, group, found = None, [], []
        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    found += links(group) if group else []
                    now, group = (key, i, j), []
                group.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found = links(group) if group else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Of rows that share the smallest id of a component, all are kept: they can't be told apart by id."""
    named = component_rows(docs, id_col, text_col, **how)
    first = named.filter("comp is not null").groupBy(F.col("comp").alias("f_comp")).agg(F.min("_id").alias("first"))
    out = named.join(first, F.col("comp") == F.col("f_comp"), "left")
    component = F.when(F.col("comp").isNull(), F.col("_id")).otherwise(F.col("first"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"))


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then text hash), once if it repeats.
    Rows without words are no duplicates and stay."""
    named = component_rows(docs, id_col, text_col, **how)
    # ids that aren't null first
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_ck")
    chosen = (named.filter("comp is not null").groupBy("comp").agg(F.min(order).alias("r"))
              .select(F.xxhash64("r._id", "r._ck").alias("_key"), F.col("r._id").alias("r_id"), F.col("r._ck").alias("r_ck")))
    df = docs.select("*", text_of(text_col).alias("__text")).withColumn("__ck", F.xxhash64("__text"))
    words = F.rlike("__text", F.lit(r"[^\x20\x09-\x0D]"))
    rows = df.filter(words).withColumn("__key", F.xxhash64(F.col(f"`{id_col}`"), "__ck"))
    rows = rows.join(chosen, (F.col("__key") == F.col("_key")) & F.col(f"`{id_col}`").eqNullSafe(F.col("r_id")) & (F.col("__ck") == F.col("r_ck")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rows.dropDuplicates(["__key"]).select(own).unionByName(df.filter(~words).select(own))


def component_rows(docs: DataFrame, id_col: str, text_col: str, *, percent: int = 75, shingle: int = 5, bands: int = 32,
                   rows: int = 4, seed: int = 1, block: int = 512) -> DataFrame:
    """_id, _ck (text hash), n (set size), comp (a number of the component, null for empty sets) per row of ``docs``."""
    how = (shingle, bands, rows, seed)
    sketch = stage(sketches(docs, id_col, text_col, *how), "op10-sketch")
    sketch = told_apart(sketch)
    nodes = sketch.filter("node is not null")
    # outer: see line_dedup; nodes has no empty key lists
    banded = nodes.select("node", F.explode_outer("keys").alias("key"))
    shared = (banded.groupBy(F.col("key").alias("s_key")).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi"))
    members = stage(banded.join(shared, F.col("key") == F.col("s_key")).select("key", "node", "lo", "hi").distinct(), "op10-members")
    chosen = (nodes.join(members.select(F.col("node").alias("m_node")).distinct(), F.col("node") == F.col("m_node"), "left_semi")
              .groupBy("node").agg(F.min(F.struct("_id", "_ck")).alias("r"))
              .select("node", F.col("r._id").alias("r_id"), F.col("r._ck").alias("r_ck")))
    sets = stage(node_sets(docs, chosen, id_col, text_col, *how), "op10-sets")

    def ordered(df, p, q):
        return df.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).filter("a != b")

    star = stage(ordered(members, "node", "lo").unionByName(ordered(members, "node", "hi")).distinct(), "op10-star")
    links = stage(verified(star, sets, percent, bands * rows), "op10-links")
    comps = components(links)
    found = stage(rest_links(members, comps, sets, percent, bands, rows, seed, block), "op10-rest")
    more = stage(verified(found, sets, percent, bands * rows), "op10-links")
    if more.limit(1).count():
        comps = components(links.unionByName(more))
    comps = comps.select(F.col("node").alias("c_node"), "comp")
    named = sketch.select("_id", "_ck", "n", "node").join(comps, F.col("node") == F.col("c_node"), "left")
    return named.select("_id", "_ck", "n", F.coalesce("comp", "node").alias("comp"))



