"""Quality rules by cross-document line frequency (DataFrame functions only).

Every line is normalised and hashed; per host the distinct documents that hold a line are counted.
Lines held by more documents than the limits allow are boilerplate and are removed; a document that
keeps too little after that is rejected. Beside it stand base rules on word counts and repeated words.

Counted are documents with different texts. Copies must not make a good text look like boilerplate, so the
lines found that way are counted once more with near copies as one document: a document is known by its *own*
lines, those that are not above the limits and do not stand in the place of one that is. (A place is what follows,
or what precedes, a certain line above the limits; it is taken if such lines hold it in most documents. One or two
lines between taken places are an edit of a copy and not its own; the text between a header and a footer is.)
Documents with the same own lines are one, and so are those without any that have the same smallest line hash above
the limits. A line is above the limits if both counts say so. Copies that differ by lines added, or by most of their
lines, are counted as different documents.

Scale: a line row is 6 longs. The first step counts rows per line, two longs each with map-side partial counts,
so a line that stands in a third of all documents arrives at the reducers as a few partial counts. Lines with too few
rows can't be above the limits; a bitmap of those that can (at most 2^17 rows of 64 bits, whatever the data) thins out the
lines before they are shuffled as distinct (line, document) pairs. It only lets more pass as it fills up; the
counts behind it are exact. The second count reads only the documents that hold a line of the first. Only narrow rows are
shuffled unless ``clean_text`` is asked for (column pruning removes the text).

Edge cases: null or empty text has no words and fails the base rules; a null host is a host of its own;
rows that repeat (same id and text) count as one document and get equal verdicts; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lines_of, normal_line, stage, text_of, words_of

WINDOW = 5


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``_words``: words in 5-word windows that occur twice or more.

    Windows are 64-bit hashes. Only a text in which some window repeats (a hash set tells) goes on: there
    hashes and positions are sorted, and equal neighbours give the covered words.
    """
    n = F.col("_n")
    df = df.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("_wh"), i + k)
    df = df.withColumn("_win", F.transform(
        F.slice("_wh", 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[at(i, k) for k in range(1, WINDOW)])))
    df = df.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    placed = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
    df = df.withColumn("_placed", F.when(F.col("_again"), F.array_sort(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    twice = F.filter("_placed", lambda x, i: (x["h"] == F.get(F.col("_placed"), i + 1)["h"])
                     | ((i > 0) & (x["h"] == F.get(F.col("_placed"), i - 1)["h"])))
    df = df.withColumn("_pos", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_pos", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0).cast("long")))


def _marked_lines(text: Column) -> Column:
    """Lines with a word, as they stand."""
    return F.filter(lines_of(text), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Per row: _id, _ck (text hash), _host, _text and the base counts. One pass, no shuffle."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").cast("string").alias("_host"),
                     text_of(text_col).alias("_text"))
    df = df.withColumn("_ck", F.xxhash64("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_n", F.size("_words"))
    df = _repeat_words(df)
    bare = F.col("_text")
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    marked = _marked_lines(F.col("_text"))
    df = df.withColumn("_marked", marked)
    n_words = F.col("_n").cast("long")
    return df.select(
        "_id", "_ck", "_host", "_text", n_words.alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_marked") - F.size(F.array_distinct("_marked"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((n_words < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n_words)).alias("base_failed"))


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of the normalised line."""
    return F.conv(F.substring(F.md5(F.encode(normal_line(line), "utf-8")), 1, 15), 16, 10).cast("long")


def line_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per line with a word: _id, _ck, _host, i (its number), h (hash of the normalised line), before and after
    (hashes of the neighbouring lines, null at the ends), w (words)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").cast("string").alias("_host"),
                     text_of(text_col).alias("_text"))
    df = df.select("_id", "_host", F.xxhash64("_text").alias("_ck"),
                   F.transform(_marked_lines(F.col("_text")),
                               lambda x: F.struct(line_hash(x).alias("h"),
                                                  F.size(words_of(x)).alias("w"))).alias("_ls"))
    df = df.withColumn("_hs", F.transform("_ls", lambda x: x["h"]))
    # the outer form, as plain explode() makes Catalyst compute the array once more to drop empty ones early
    df = df.select("_id", "_host", "_ck", F.explode_outer(F.transform("_ls", lambda x, i: F.struct(
        i.alias("i"), x["h"].alias("h"), x["w"].alias("w"),
        F.when(i > 0, F.get(F.col("_hs"), i - 1)).alias("before"), F.get(F.col("_hs"), i + 1).alias("after")))).alias("l"))
    df = df.filter(F.col("l").isNotNull())
    return df.select("_id", "_host", "_ck", "l.i", "l.h", "l.w", "l.before", "l.after")


def _same(df: DataFrame, other: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    """``df`` joined with ``other`` on the host, which may be null, and on ``on``; their keys are named apart before."""
    other = other.withColumnsRenamed({"_host": "_o_host", **{c: f"_o_{c}" for c in on.values()}})
    fits = F.col("_host").eqNullSafe(F.col("_o_host"))
    for mine, its in on.items():
        fits &= F.col(mine) == F.col(f"_o_{its}")
    out = df.join(other, fits, how)
    return out.drop("_o_host", *[f"_o_{c}" for c in on.values()])


#: Bits of the bitmap that thins out lines: 2^17 words of 64.
MAP_BITS = 1 << 23


def _bit_of(host: str, key: str) -> tuple[Column, Column]:
    """Word and bit of a line or document of a host."""
    bit = F.pmod(F.xxhash64(host, key), F.lit(MAP_BITS)).cast("int")
    return F.floor(bit / 64).cast("int"), bit % 64


def _thinned(lines: DataFrame, wanted: DataFrame, key: str = "h") -> DataFrame:
    """``lines`` without most of those whose (_host, key) is not in ``wanted``; none that is in it goes."""
    word, bit = _bit_of("_host", key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = wanted.select(word.alias("_word"), one.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    # at most MAP_BITS / 64 rows
    hit = lines.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word").filter(F.call_function("bit_get", F.col("_bits"), F.col("_bit")) == 1)
    return hit.select(*lines.columns)


def frequent_lines(lines: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(f_host, f_h) of the lines above the limits."""
    hosts = stage(lines.select("_host", "_ck").distinct().groupBy("_host").agg(F.count("*").alias("host_docs")), "op1-hosts")
    # a line has no more documents than rows
    rows = lines.groupBy(F.xxhash64(F.coalesce(F.concat(F.lit("h"), "_host"), F.lit(""))).alias("hk"), "h").agg(F.count("*").alias("n"))
    rows = rows.filter(F.col("n") > min_docs)
    by_hash = hosts.select("_host", "host_docs", F.xxhash64(F.coalesce(F.concat(F.lit("h"), "_host"), F.lit(""))).alias("hk"))
    wanted = rows.join(by_hash, "hk").filter(F.col("n") > max_share * F.col("host_docs"))
    per_doc = stage(_thinned(lines.select("_host", "h", "_ck"), wanted).distinct(), "op1-pairs")
    often = per_doc.groupBy("_host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    often = stage(_same(often, hosts, {}, "inner").filter(F.col("n_docs") > max_share * F.col("host_docs")), "op1-often")

    held = stage(_same(per_doc, often, {"h": "h"}, "left_semi"), "op1-held")
    holders = held.groupBy("_host", "_ck").agg(F.min("h").cast("decimal(38,0)").alias("least"))
    inside = _thinned(lines.select("_host", "_ck", "h", "before", "after"), holders.select("_host", "_ck"), "_ck")
    # inner joins with unique keys, as Catalyst would move a semi join in front of the thinning
    inside = _same(inside, holders.select("_host", "_ck"), {"_ck": "_ck"}, "inner").distinct()
    for line, flag in (("h", "often"), ("before", "often_before"), ("after", "often_after")):
        inside = _same(inside, often.select("_host", "h", F.lit(True).alias(flag)), {line: "h"}, "left")
    after = F.xxhash64(F.lit("after"), "before", F.col("after").isNull())
    until = F.xxhash64(F.lit("before"), "after", F.col("before").isNull())
    inside = stage(inside.select("_host", "_ck", "h", F.col("often").isNotNull().alias("often"),
                                 F.when(F.col("often_before"), after).alias("p"),
                                 F.when(F.col("often_after"), until).alias("q")), "op1-inside")
    taken = (inside.select("_host", "often", F.explode(F.array("p", "q")).alias("place")).filter("place is not null")
             .groupBy("_host", "place").agg(F.count("*").alias("n"), F.count_if("often").alias("k")).filter("2 * k > n"))
    own = inside.filter("not often")
    for place, flag in (("p", "taken_p"), ("q", "taken_q")):
        own = _same(own, taken.select("_host", "place", F.lit(True).alias(flag)), {place: "place"}, "left")
    # edited: a run of lines between taken places; its inner borders and the text's ends count neither way
    open_ = lambda place, flag: F.col(place).isNotNull() & F.col(flag).isNull()
    own = own.filter(open_("p", "taken_p") | open_("q", "taken_q") | (F.col("p").isNull() & F.col("q").isNull()))
    # one number per set of own lines
    own = (own.select("_host", "_ck", "h").distinct().groupBy("_host", "_ck")
           .agg(F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("own")))
    known = _same(holders, own, {"_ck": "_ck"}, "left")
    known = stage(known.select("_host", "_ck", F.coalesce("own", "least").alias("own")), "op1-own")
    copies = (known.groupBy("_host", "own").agg(F.count("*").alias("n"))
              .groupBy("_host").agg((F.sum("n") - F.count("*")).alias("copies")))
    apart = (_same(held, known, {"_ck": "_ck"}, "inner").groupBy("_host", "h", "own").agg(F.lit(1).alias("one"))
             .groupBy("_host", "h").agg(F.count("*").alias("n_apart")))
    both = _same(_same(often, apart, {"h": "h"}, "inner"), copies, {}, "inner")
    return (both.filter((F.col("n_apart") > min_docs) & (F.col("n_apart") > max_share * (F.col("host_docs") - F.col("copies"))))
            .select(F.col("_host").alias("f_host"), F.col("h").alias("f_h")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row per document: id, base counts, base_failed, kept, removed_lines, removed_words, clean_text. See ``judged``."""
    return judged(docs, id_col, text_col, host_col, **limits).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "removed_lines", "removed_words", "clean_text")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, the text without the removed lines."""
    # written first: a filter on the verdict would be pushed below the counts and repeat them for each array element
    verdict = stage(judged(docs, id_col, text_col, host_col, **limits).select(
        F.col("_id").alias("v_id"), F.col("_ck").alias("v_ck"), F.col("_host").alias("v_host"), "kept", "_gone_h"), "op1-verdicts")
    verdict = verdict.filter("kept").dropDuplicates(["v_id", "v_ck", "v_host"])
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"),
                     F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").cast("string").alias("_host"),
                     text_of(text_col).alias("_text"))
    out = df.join(verdict, F.col("_id").eqNullSafe(F.col("v_id")) & (F.xxhash64("_text") == F.col("v_ck"))
                  & F.col("_host").eqNullSafe(F.col("v_host")))
    return out.select(*[(_clean() if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _clean() -> Column:
    """_text without the lines whose hashes are in _gone_h."""
    left = F.array_join(F.filter(lines_of(F.col("_text")), lambda x: ~F.array_contains(
        F.col("_gone_h"), line_hash(x))), "\n")
    return F.when(F.size("_gone_h") == 0, F.col("_text")).otherwise(left)


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, *, min_docs: int = 10, max_share: float = 0.005,
           min_left_share: float = 0.3) -> DataFrame:
    """_id, _ck, _host, base counts, verdicts, _gone_h (hashes of removed lines), clean_text of every document.

    A line is removed if, on its host, it stands in more than ``min_docs`` different texts and in more
    than ``max_share`` of them, and still does with near copies as one. Lines of every
    length count. A document is rejected if it fails the base rules, or if lines were removed and
    less than ``min_left_share`` of its words are left.
    """
    lines = stage(line_rows(docs, id_col, text_col, host_col), "op1-lines")
    often = frequent_lines(lines, min_docs, max_share)
    often = stage(often, "op1-above")
    hit = _thinned(lines, often.select(F.col("f_host").alias("_host"), F.col("f_h").alias("h")))
    hit = hit.join(often, F.col("_host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h"))).drop("f_host", "f_h")
    # a set, as a repeated row brings its lines again; bounded by the document's own lines
    gone = (hit.groupBy("_id", "_ck", "_host").agg(F.collect_set(F.struct("i", "h", "w")).alias("_gone"))
            .select(F.col("_id").alias("g_id"), F.col("_ck").alias("g_ck"), F.col("_host").alias("g_host"), "_gone"))
    rows = base_counts(docs, id_col, text_col, host_col)
    out = rows.join(gone, F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_ck") == F.col("g_ck"))
                    & F.col("_host").eqNullSafe(F.col("g_host")), "left")
    out = out.withColumn("_gone", F.coalesce("_gone", F.array().cast(gone.schema["_gone"].dataType)))
    out = out.withColumn("removed_words", F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + x["w"]))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (left < min_left_share * F.col("n_words"))
    out = out.withColumn("_gone_h", F.transform("_gone", lambda x: x["h"]))
    return out.select(
        "_id", "_ck", "_host", "_gone_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.size("_gone").cast("long").alias("removed_lines"), "removed_words",
        _clean().alias("clean_text"))
