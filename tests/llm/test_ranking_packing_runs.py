"""Best-fit packing, lexical search and periodic runs against plain versions, on hand-made rows and the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from panelspark.llm import op11_best_fit_packing as op11, op12_lexical_search as op12, op13_periodic_runs as op13
from panelspark.llm.queries import QUERIES, planted_repeats, tokenizer_path

SF = "/root/testdata/sf0.001"
# extra columns carry names that the operators use inside
DOCS = "doc_id long, text string, length string, _id string, _task string, _rank string, piece string, _vec string, runs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "1", "2", "3", "4", "5", "6", "7") for i, t in rows], DOCS)


ODD = [(1, "a b c a b c a b c a b c tail"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (5, "one"), (6, "x " * 9000 + "é ñ 日本"),
       (None, "go go go go go go go stop"), (7, "<|endoftext|> Aé-é_É\x00 x " * 3), (8, " ".join(f"w{i % 300}" for i in range(3000)))]


# --- best-fit packing -------------------------------------------------------------------------

def least_bins(sizes, room):
    """Fewest sequences for a few pieces, by exhaustion."""
    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            inside = [x for i, x in enumerate(rest) if mask >> i & 1]
            if first + sum(inside) <= room:
                best = min(best, 1 + least(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best
    return least(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_a_smallest_packing(seed):
    rnd = random.Random(seed)
    room = rnd.choice([10, 30, 100])
    low = rnd.choice([1, room // 6, room // 4])
    sizes = [rnd.randint(max(low, 1), room) for _ in range(rnd.randint(1, 9))]
    todo = op11.Instance(Counter(sizes), room)
    todo.reduce()
    rest = [s for s, n in todo.left.items() for _ in range(n)]
    assert todo.sequences + least_bins(rest, room) == least_bins(sizes, room)
    assert all(sum(x) <= room for x in sequences_of(todo.slots).values())


def sequences_of(slots):
    """Lengths in each sequence, having checked that ranks are used once and offsets leave no gap."""
    at, ranks = {}, {}
    for s in slots:
        for i in range(s.count):
            at.setdefault(s.sequence + i // s.each, []).append((s.offset + i % s.each * s.length, s.length))
            ranks.setdefault(s.length, []).append(s.first + i)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for pieces in at.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
    return {k: [x for _, x in v] for k, v in at.items()}


def test_the_third_rule_and_pairs():
    assert op11.Instance(Counter([20]), 20).dominating(20) == (20,)
    assert op11.Instance(Counter([12, 8, 3]), 20).dominating(12) == (12, 8)  # fills it
    assert op11.Instance(Counter([12, 7, 5]), 20).dominating(12) == (12, 7)  # no two others fit
    assert op11.Instance(Counter([11, 8, 4, 4, 4]), 20).dominating(11) == (11, 8)  # as long as any two
    assert op11.Instance(Counter([10, 5, 4, 4]), 20).dominating(10) == (10, 5, 4)
    assert op11.Instance(Counter([10, 7, 5, 5, 3]), 20).dominating(10) is None  # 5 + 5 and 7 + 3 fill it alike
    assert op11.Instance(Counter([2] * 9), 20).dominating(2) is None


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_one_piece_at_a_time(seed):
    rnd = random.Random(seed)
    room = rnd.choice([16, 64, 200])
    sizes = sorted((rnd.randint(1, room) for _ in range(rnd.randint(0, 400))), reverse=True)
    todo = op11.Instance(Counter(sizes), room)
    todo.best_fit()
    bins = []
    for s in sizes:
        fit = [b for b in bins if room - sum(b) >= s]
        if fit:
            min(fit, key=lambda b: room - sum(b)).append(s)
        else:
            bins.append([s])
    got = sequences_of(todo.slots)
    assert sorted(map(sum, got.values())) == sorted(map(sum, bins))


def test_plan_over_many_pieces_is_near_the_lower_bound():
    rnd = np.random.default_rng(1)
    sizes = np.clip(rnd.lognormal(5.5, 1, 200_000).astype(int), 1, 2048)
    got = sequences_of(op11.plan(Counter(sizes.tolist()), 2048))
    assert sum(map(len, got.values())) == len(sizes) and max(map(sum, got.values())) <= 2048
    assert len(got) <= math.ceil(sizes.sum() / 2048) * 1.0005


def check_packing(rows, got, room, ids_of):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(map(str, by_doc)) == sorted({str(i) for i, _ in rows})
    for doc, text in rows:
        ids = ids_of(text)
        copies = sum(1 for i, _ in rows if i == doc)
        own = sorted(by_doc[doc], key=lambda r: r.start)
        first = len(ids) % room or room
        cuts = [0, *range(first, len(ids) + 1, room)]
        want = [(k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert [(r.piece, r.start, r.length, bytes(r.ids)) for r in own] == sorted(want * copies, key=lambda x: x[1])
    for pieces in by_sequence.values():
        upto = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == upto
            upto += r.length
        assert upto <= room


def library_ids():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation(), tok.no_padding()
    return lambda text: np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize(("room", "counts"), [(2048, 1000), (16, 1000), (16, 0)])
def test_packing_of_odd_texts(spark, room, counts):
    docs = frame(spark, ODD).repartition(3)
    packed = op11.pack_whole_documents(docs, tokenizer_path(), room=room, broadcast_counts=counts)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (counts == 0) and ("BroadcastHashJoin" in plan) == (counts > 0)
    check_packing(ODD, packed.collect(), room, library_ids())
    assert op11.pack_whole_documents(frame(spark, []), tokenizer_path(), room=room, broadcast_counts=counts).collect() == []


def test_packing_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op11.pack_whole_documents(spark.read.parquet(f"{SF}/documents.parquet"), tokenizer_path()).collect()
    check_packing(rows, got, 2048, library_ids())
    digest = {(r.doc_id, r.piece): r.ids_crc32 for r in QUERIES["op11_best_fit_packing"](spark, SF).collect()}
    assert digest == {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in got}


# --- lexical search ---------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(items, docs, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in set(terms(text)) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, items, docs, **more):
    df = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in op12.lexical_search(df, frame(spark, docs).repartition(4), **more).collect()), key=str)


SEARCH_DOCS = ODD + [(100 + i, "same copy of one text") for i in range(40)] + [(200 + i, f"same other {'pad ' * (i % 3)}") for i in range(30)]
ITEMS = [(1, "Same COPY, other?"), (2, None), (3, ""), (4, "no_such word"), (5, "é ñ 日本 x"), (6, "go w1 w2 one"), (6, "go w1 w2 one"), (None, "pad")]


@pytest.mark.parametrize("max_terms", [500_000, 4])
def test_search_equals_the_plain_one(spark, max_terms):
    assert found(spark, ITEMS, SEARCH_DOCS, max_terms=max_terms) == plain_search(ITEMS, SEARCH_DOCS)


def test_search_of_few_and_of_none(spark):
    assert found(spark, ITEMS, SEARCH_DOCS, k=3) == plain_search(ITEMS, SEARCH_DOCS, 3)
    assert found(spark, ITEMS, []) == [] and found(spark, [], SEARCH_DOCS) == [] and found(spark, [(1, "?")], SEARCH_DOCS) == []


def test_sums_beyond_doubles_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(op12, "DOUBLES_WHOLE_BELOW", 0)
    assert found(spark, ITEMS, SEARCH_DOCS) == plain_search(ITEMS, SEARCH_DOCS)


def test_a_class_is_scored_once(spark):
    docs = frame(spark, SEARCH_DOCS).selectExpr("doc_id AS _id", "coalesce(text, '') AS _text")
    vocabulary = sorted({"same", "copy", "other", "pad", "one"})
    vectors = op12.term_vectors(docs, vocabulary)
    from pyspark.sql import functions as F
    classes = op12.bag_classes(vectors, F.col("_n"), 10).collect()
    bags = {(sum(Counter(terms(t)).values()), tuple(sorted((x, n) for x, n in Counter(terms(t)).items() if x in vocabulary)))
            for _, t in SEARCH_DOCS if set(terms(t)) & set(vocabulary)}
    assert len(classes) == len(bags)
    assert sorted(len(c._ids) for c in classes if 100 in c._ids) == [10] and [100 + i for i in range(10)] in [c._ids for c in classes]


# --- periodic runs ----------------------------------------------------------------------------

def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            w = words[i:j + q]
            if length >= max(6, 4 * q) and not any(all(w[t] == w[t + p] for t in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same_runs(got, rows):
    want = sorted(((str(i), len(split(t)), *plain_row(split(t))) for i, t in rows), key=str)
    have = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed_text) for r in got), key=str)
    assert have == want


def test_runs_of_odd_texts(spark):
    rows = [r for r in ODD if r[0] != 6] + [(20, "a " * 700), (21, "a b " * 3 + "a"), (22, "a b " * 4), (23, "a a b " * 9 + "a a b b"),
                                            (24, ("p q r p q s " * 6) + "p q"), (25, "x y" * 3), (26, "a a a a a b a a a a a a")]
    same_runs(op13.periodic_runs(frame(spark, rows).repartition(3)).collect(), rows)
    assert op13.periodic_runs(frame(spark, [])).collect() == []


def test_a_very_long_text(spark):
    got = op13.periodic_runs(frame(spark, [(1, "a b " * 200_000), (2, " ".join(map(str, range(200_000))))])).orderBy("doc_id").collect()
    assert [tuple(x) for x in got[0].runs] == [(0, 400_000, 2)] and got[0].collapsed_text == "a b"
    assert got[1].runs == [] and got[1].n_words == 200_000 and got[1].best is None


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randint(1, 25)
            unit = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(p)]
            at = rnd.randint(0, len(words))
            words[at:at] = (unit * 8)[:rnd.randint(3 * p, 7 * p)]
        texts.append(words)
    flat = np.array([w for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    got = {}
    for t, run in op13.find_runs(flat, sizes):
        got.setdefault(t, []).append(run)
    assert [got.get(t, []) for t in range(len(texts))] == [plain_runs(w) for w in texts]


def test_other_limits():
    words = np.array([0, 1, 2] * 3 + [5, 6] * 10 + [7] * 4)
    runs = [r for _, r in op13.find_runs(words, np.array([len(words)]), 4, 3)]
    assert runs == [(0, 9, 3), (9, 20, 2), (29, 4, 1)]
    assert [op13.guaranteed_overlap(b, 6, 4) for b in range(5)] == [5, 6, 12, 24, 48]


def test_runs_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    planted = 0
    for r in docs.collect():
        words = split(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs, best, text = plain_row(words)
        sha = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        own = got.pop(r.doc_id)
        assert (own.n_runs, own.runs_sha256, own.collapsed_sha256) == (len(runs), sha, hashlib.sha256(text.encode()).hexdigest())
        assert (own.start, own.length, own.period) == (best or (None,) * 3)
        assert own.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert not got and planted > 5
    odd = planted_repeats(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD)
