"""The numbered queries, each a thin call of its operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, imatch, lexical, licenses, media, mixing, packing, pii, probminhash, quality, secrets, sharding, warc
from .shared import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def trainable(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learnt from: a fifth, by document id, is held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


#: For runs of these queries; a real one comes from whoever keeps the keys.
PII_KEY = "sitewright-demonstration-key"


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    count = lambda k: F.coalesce(F.element_at("pii", k), F.lit(0)).cast("int").alias(f"n_{k}")
    return made.select("doc_id", "text", "lang", "source", "n_chars", *map(count, pii.KINDS))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), max_tokens=1024)


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


@query
def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_position(mixing.assign(table(spark, sf_dir, "documents"), schedules=mixing.SCHEDULES))


ORACLE_SQL["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio FROM weighed),
filled AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY ratio, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM levels),
watered AS (
  SELECT *, (SELECT min_by(level, (ratio, ord)) FROM filled WHERE level <= ratio) AS water FROM filled),
targets AS (
  SELECT source, source_size, ord, CASE WHEN water IS NULL OR ratio < water THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM watered),
schedules AS (
  SELECT * FROM (VALUES
    (0, [{'t0': 0.0, 'w0': 2.0, 't1': 0.5, 'w1': 1.0}, {'t0': 0.5, 'w0': 1.0, 't1': 1.0, 'w1': 0.25}]),
    (1, [{'t0': 0.0, 'w0': 0.0, 't1': 0.25, 'w1': 0.5}, {'t0': 0.25, 'w0': 0.5, 't1': 1.0, 'w1': 2.0}]),
    (2, [{'t0': 0.0, 'w0': 0.5, 't1': 0.5, 'w1': 2.0}, {'t0': 0.5, 'w0': 2.0, 't1': 1.0, 'w1': 0.5}])) v(nth, pieces)),
areas AS (
  SELECT nth, CAST(p.t0 AS DOUBLE) AS t0, CAST(p.w0 AS DOUBLE) AS w0, CAST(p.t1 - p.t0 AS DOUBLE) AS dt, CAST(p.w1 AS DOUBLE) AS w1,
         CAST((p.w0 + p.w1) / 2 * (p.t1 - p.t0) AS DOUBLE) AS area
  FROM (SELECT nth, unnest(pieces) AS p FROM schedules)),
reached AS (
  SELECT *, coalesce(sum(area) OVER (PARTITION BY nth ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(area) OVER (PARTITION BY nth) AS whole FROM areas),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, (t.ord - 1) % 3 AS nth,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY CAST('0x' || left(s.draw, 4) AS INT) % 1024, s.draw, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, row_number() OVER () AS row, size > 0 AND middle < target AS once, size > 0 AND middle + source_size < target AS twice FROM placed),
shares AS (
  SELECT row, nth, 1 AS copy, least(middle / target, 1.0::DOUBLE) AS share FROM copies WHERE once UNION ALL
  SELECT row, nth, 2, least((middle + source_size) / target, 1.0::DOUBLE) FROM copies WHERE twice),
positions AS (
  SELECT row, copy, min_by(t0 + coalesce(2 * left_over / nullif(w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) / dt * left_over, 0)), 0), 0), t0) AS position
  FROM (SELECT s.row, s.copy, r.*, least(s.share * r.whole - r.before, r.area) AS left_over FROM shares s JOIN reached r USING (nth)
        WHERE s.share * r.whole <= r.before + r.area OR r.t0 + r.dt >= 1) GROUP BY row, copy)
SELECT doc_id, size, source_size, target, CAST(size * (CAST(once AS BIGINT) + CAST(twice AS BIGINT)) AS BIGINT) AS taken,
       round(a.position, 9) AS position, round(b.position, 9) AS position_again
FROM copies c LEFT JOIN positions a ON a.row = c.row AND a.copy = 1 LEFT JOIN positions b ON b.row = c.row AND b.copy = 2
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network, _ = quality.learn(docs, trainable(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, network, threshold=0.3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(listed, lambda s: ~s.startswith("grammar:"))
    by_grammar = F.filter("spans", lambda s: s["kind"] == "grammar")
    formats = F.transform(by_grammar, lambda s: F.concat_ws(":", s["format"], F.format_number(s["gain"], 2)))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(listed, ",").alias("spans"),
        "n_grammar", F.array_join(formats, ",").alias("formats"),
    )


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE_SQL["op10_licenses"] = licenses.duckdb_sql()


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op11_lexical"] = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
kept AS (
  SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM kept),
normed AS (
  SELECT doc_id, terms, 10 + (90 * n * docs) // words AS m FROM kept, totals),
postings AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM normed) GROUP BY doc_id, m, term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN weighed USING (term) JOIN postings USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || CAST(doc_id AS VARCHAR)) AS draw
  FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || draw[1:8] AS BIGINT) AS h1, CAST('0x' || draw[9:16] AS BIGINT) AS h2, CAST('0x' || draw[25:32] AS BIGINT) AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:n], '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.sharded(table(spark, sf_dir, "documents"), new_folder(spark, "shards") + "/rows", shards=8)
    text = F.coalesce("text", F.lit(""))
    return stored.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


ORACLE_SQL["op13_sharding"] = r"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR))[1:16] AS draw, row_number() OVER () AS row FROM documents),
jumps AS (
  SELECT row, CAST('0x' || draw AS UBIGINT)::HUGEINT AS state, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS ahead FROM keyed
  UNION ALL
  SELECT row, drawn, ahead, CAST(floor(CAST(ahead + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST(drawn // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT row, ahead, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS drawn FROM jumps WHERE ahead < 9)),
shards AS (
  SELECT row, CAST(max(shard) FILTER (shard < 8) AS INT) AS shard, CAST(max(shard) FILTER (shard < 9) AS INT) AS grown_shard FROM jumps GROUP BY row),
bits AS (
  SELECT CAST(range AS BIGINT) AS byte, CAST(range AS BIGINT) AS crc, 0 AS bit FROM range(256)
  UNION ALL SELECT byte, CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1 FROM bits WHERE bit < 8),
steps AS MATERIALIZED (
  SELECT list(crc ORDER BY byte) AS step FROM bits WHERE bit = 8),
bytes AS (
  SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS octets FROM keyed)
SELECT doc_id, CAST(len(octets) + 1 AS BIGINT) AS size,
       xor(list_reduce(list_concat([4294967295::BIGINT], octets), lambda crc, octet: xor(crc >> 8, step[1 + (xor(crc, octet) & 255)])), 4294967295::BIGINT) AS text_crc32,
       'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id) - 1 AS slot, grown_shard
FROM bytes JOIN shards USING (row), steps
"""
