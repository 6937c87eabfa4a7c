"""The queries of the corpus operators, one per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_quality_rules as op1
from . import op02_lsh_search as op2
from . import op03_line_dedup as op3
from . import op04_warc as op4
from . import op05_url_templates as op5
from . import op06_secret_scan as op6
from . import op07_packing as op7
from . import op08_bpe as op8
from . import op09_toxicity as op9
from . import op10_minhash as op10
from . import op11_best_fit_packing as op11
from . import op12_lexical_search as op12
from . import op13_periodic_runs as op13
from .common import NORMAL_LINE_SQL, table, text_of, words_of

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op2_lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "deleted_lines", F.size("deleted_runs").cast("long").alias("n_runs"),
        F.md5(F.encode("clean_text", "utf-8")).alias("clean_md5"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = op4.archive_folder(spark)
    index = op4.write_archives(table(spark, sf_dir, "pages"), folder)
    return op4.read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.url_verdicts(table(spark, sf_dir, "pages"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op6.secret_spans(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in op6.BASE_RULES]
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return df.select(
        "doc_id", *[F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op7.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = op8.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return op8.decode_documents(tokens, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = op9.toxicity(docs, op9.fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op11.pack_whole_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents (by a hash of the id) the words from one place on repeat with a period."""
    df = docs.select("doc_id", text_of("text").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    df = df.withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    df = df.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    df = df.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    df = df.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast((n - a + p - 1) div p as int)")))
    whole = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return df.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op13.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed_text", "utf-8"), 256).alias("collapsed_sha256"))


#: Lines with a word of every document: d (document number), i (raw line number), t (normalised), w (words).
LINES_SQL = f"""
docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs),
ls AS (SELECT doc_id, source, i, x, {NORMAL_LINE_SQL.format('x')} AS t,
              len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w,
              row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
       FROM raw WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"""

ORACLE["op1_quality_rules"] = f"""
WITH {LINES_SQL},
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM again) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM ls GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
         FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
texts AS (SELECT doc_id, coalesce('h' || source, '') AS host, md5(text) AS ck FROM docs),
lh AS (SELECT doc_id, i, w, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h FROM ls),
seen AS (SELECT DISTINCT host, ck, h, before, after
         FROM (SELECT *, lag(h) OVER o AS before, lead(h) OVER o AS after FROM lh WINDOW o AS (PARTITION BY doc_id ORDER BY i))
         JOIN texts USING (doc_id)),
pairs AS (SELECT DISTINCT host, ck, h FROM seen),
hosts AS (SELECT host, count(DISTINCT ck) AS host_docs FROM seen GROUP BY host),
often AS (SELECT host, h, n_docs, host_docs FROM (SELECT host, h, count(*) AS n_docs FROM pairs GROUP BY host, h)
          JOIN hosts USING (host) WHERE n_docs > 10 AND n_docs > 0.005 * host_docs),
held AS (SELECT * FROM pairs SEMI JOIN often USING (host, h)),
holders AS (SELECT host, ck, min(h) AS least FROM held GROUP BY host, ck),
inside AS (SELECT host, ck, h, h IN (SELECT o.h FROM often o WHERE o.host = seen.host) AS frequent,
             CASE WHEN before IN (SELECT o.h FROM often o WHERE o.host = seen.host)
                  THEN 'after' || before || (after IS NULL) END AS p,
             CASE WHEN after IN (SELECT o.h FROM often o WHERE o.host = seen.host)
                  THEN 'before' || after || (before IS NULL) END AS q
           FROM seen SEMI JOIN holders USING (host, ck)),
taken AS (SELECT host, place FROM (SELECT host, frequent, unnest([p, q]) AS place FROM inside) WHERE place IS NOT NULL
          GROUP BY host, place HAVING 2 * count(*) FILTER (WHERE frequent) > count(*)),
free AS (SELECT inside.host, ck, h FROM inside LEFT JOIN taken a ON a.host = inside.host AND a.place = p
           LEFT JOIN taken b ON b.host = inside.host AND b.place = q
         WHERE NOT frequent AND (p IS NOT NULL AND a.place IS NULL OR q IS NOT NULL AND b.place IS NULL OR p IS NULL AND q IS NULL)),
own AS (SELECT host, ck, 's' || string_agg(DISTINCT CAST(h AS VARCHAR), ',' ORDER BY CAST(h AS VARCHAR)) AS own FROM free GROUP BY host, ck),
known AS (SELECT host, ck, coalesce(own, 'l' || least) AS own FROM holders LEFT JOIN own USING (host, ck)),
copies AS (SELECT host, count(*) - count(DISTINCT own) AS copies FROM known GROUP BY host),
apart AS (SELECT host, h, count(DISTINCT own) AS n_apart FROM held JOIN known USING (host, ck) GROUP BY host, h),
above AS (SELECT host, h FROM often JOIN apart USING (host, h) JOIN copies USING (host)
          WHERE n_apart > 10 AND n_apart > 0.005 * (host_docs - copies)),
gone AS (SELECT doc_id, count(*) AS removed_lines, CAST(sum(w) AS BIGINT) AS removed_words
         FROM lh JOIN texts USING (doc_id) SEMI JOIN above USING (host, h) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (coalesce(removed_words, 0) > 0 AND n_words - removed_words < 0.3 * n_words) AS kept,
       coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words
FROM base LEFT JOIN gone USING (doc_id)"""

ORACLE["op3_line_dedup"] = f"""
WITH {LINES_SQL},
c AS (SELECT doc_id, i, k, t, w, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM ls),
win AS (SELECT x.doc_id, x.k AS a, min(y.k) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k >= x.k
          AND y.upto - x.upto + x.w >= 50 GROUP BY ALL
        UNION SELECT x.doc_id, max(y.k) AS a, x.k AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k <= x.k
          AND x.upto - y.upto + y.w >= 50 GROUP BY x.doc_id, x.k),
keyed AS (SELECT win.doc_id, a, b, string_agg(t, chr(10) ORDER BY k) AS g
          FROM win JOIN c ON c.doc_id = win.doc_id AND c.k BETWEEN a AND b GROUP BY ALL),
seeds AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) > 1 AS later FROM keyed),
hit AS (SELECT DISTINCT c.doc_id, c.k FROM seeds JOIN c ON c.doc_id = seeds.doc_id AND c.k BETWEEN a AND b WHERE later),
runs AS (SELECT doc_id, min(k) AS a, max(k) AS b
         FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hit) GROUP BY doc_id, run),
spans AS (SELECT runs.doc_id, x.i AS a, y.i AS b FROM runs JOIN c x ON x.doc_id = runs.doc_id AND x.k = runs.a
          JOIN c y ON y.doc_id = runs.doc_id AND y.k = runs.b),
kept AS (SELECT raw.doc_id, raw.i, raw.x FROM raw WHERE NOT EXISTS
           (SELECT 1 FROM spans WHERE spans.doc_id = raw.doc_id AND raw.i BETWEEN spans.a AND spans.b)),
texts AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS clean FROM kept GROUP BY doc_id)
SELECT docs.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(nh.n, 0) AS deleted_lines, coalesce(nr.n, 0) AS n_runs,
       md5(coalesce(clean, '')) AS clean_md5
FROM docs LEFT JOIN texts USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM ls GROUP BY doc_id) nl USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) nh USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id) nr USING (doc_id)"""

ORACLE["op10_minhash"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
       GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * common >= 75 * (p.n + q.n - common)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
smallest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(y, words.doc_id)) AS component_id,
       least(words.doc_id, coalesce(y, words.doc_id)) = words.doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON x = words.doc_id"""

ORACLE["op12_lexical_search"] = r"""
WITH terms AS (SELECT doc_id, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
               FROM (SELECT *, row_number() OVER () AS k FROM documents)),
asked AS (SELECT DISTINCT item_id, j, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
          FROM (SELECT *, row_number() OVER () AS j FROM benchmark)),
sizes AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY k),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
tfs AS (SELECT k, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM asked) GROUP BY k, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tfs, total GROUP BY t),
parts AS (SELECT k, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS part
          FROM tfs JOIN sizes USING (k) JOIN weights USING (t), total),
scores AS (SELECT item_id, j, k, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (t) GROUP BY item_id, j, k),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scores JOIN sizes USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
