"""Queries and oracle SQL of this package's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, fingerprint, html_text, language_id, near_dedup, ngram_join, periodic_runs, quality, token_files, toxicity, vector_codes
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = crc_mod("doc_id", 3)
    profiles = language_id.fit(docs.where(remainder != 1), "doc_id", "text", "lang")
    found = language_id.identify(docs, profiles)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat_format.format_digests(rows.unionByName(more))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed package of public tokenizers, at the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2, percent=80)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, remainder = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"), crc_mod("doc_id", 5)
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(remainder != 0)))
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted", "hits")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, remainder = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), crc_mod("doc_id", 5)
    found = quality.score(docs, quality.fit(docs, labels.where(remainder != 0)))
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")


#: Words as the contracts take them: runs of anything but 0x20 and 0x09-0x0D.
WORDS = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document, and in those whose id's crc32 ends in 0 the words from one on repeat a first period."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), F.expr(f"case when pmod(h, 10) = 0 then {WORDS} end").alias("ws"))
    placed = hashed.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("case when size(ws) > 0 then pmod(g, size(ws)) end"))
    period = placed.withColumn("p", F.expr("1 + (size(ws) - a) div (3 + pmod(g, 8))"))
    repeated = "array_join(transform(sequence(0, size(ws) - 1), i -> ws[int(case when i < a then i else a + pmod(i - a, p) end)]), ' ')"
    return period.select("doc_id", F.expr(f"case when a is null then text else {repeated} end").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(planted(table(spark, sf_dir, "documents", "doc_id", "text")))
    stronger = "case when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, 1) end"
    best = found.withColumn("best", F.expr(f"get(array_sort(runs, (x, y) -> {stronger}), 0)"))
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = vector_codes.fit(vectors, "vec_id", "embedding")
    coded = vector_codes.encode(vectors, books, "vec_id", "embedding", "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents", "doc_id", "text"), width=5, percent=80)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprint": op7_fingerprint,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_ngram_join": op13_ngram_join,
}

_DISTANCE = "list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
_ASSIGN = """a{k} AS (SELECT v.vec_id, v.label, v.p, v.x, min(""" + _DISTANCE.format(x="v.x", y="c.x") + """ * 64 + c.e) AS best FROM v JOIN c{k} c USING (p) GROUP BY ALL)"""
_MOVE = """m{k} AS (
  SELECT p, e, list(floor(s / n::DOUBLE)::BIGINT ORDER BY j) AS x FROM (
    SELECT p, best % 64 AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) t(j) GROUP BY ALL) GROUP BY p, e),
c{next} AS (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))"""

VECTOR_CODES = ",\n".join([
    """WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, p, x[1 + p * len(x) // 16 : (p + 1) * len(x) // 16] AS x FROM u, unnest(range(16)) t(p)),
c0 AS (SELECT p, rank - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM v) WHERE rank <= 64)""",
    _ASSIGN.format(k=0), _MOVE.format(k=0, next=1), _ASSIGN.format(k=1), _MOVE.format(k=1, next=2), _ASSIGN.format(k=2),
    """b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM c2)
SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error,
  (sum(sum(best // 64)) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT digest FROM b) AS codebooks_sha256
FROM a2 GROUP BY vec_id, label""",
])

ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : ' || role || ' </turn>' || chr(10)) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars,
  false AS rewrites_history, NULL::BIGINT AS first_rewritten_turn
FROM c GROUP BY conv_id
""",
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
""",
    "op11_periodic_runs": r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda d: ascii(d)::BIGINT)), lambda a, d: list_reduce(list_prepend(xor(a, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM c),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE ws END AS ws FROM g),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    arg_max({'s': start, 'l': length, 'p': period}, [length / period::DOUBLE, -start, -period]) AS best FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  coalesce(b.runs_sha256, sha256('')) AS runs_sha256, coalesce(k.collapsed, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op12_vector_codes": VECTOR_CODES,
    "op13_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
""",
}
