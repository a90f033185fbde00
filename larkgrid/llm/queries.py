"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm import chosen_path, decontaminate, langid, line_dedup, mixing, ngram_lm, omh, style_tree, toxicity, warc
from larkgrid.llm.common import materialize, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    out = ngram_lm.score_texts(table(spark, sf_dir, "documents"), "doc_id", fold != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    mixed = mixing.with_copies(sized, mixing.mix_plan(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = style_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), host=F.col("source"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages, with declared language, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    return langid.identify(pages, langid.fit(table(spark, sf_dir, "documents")), key="page_id", **langid.page_evidence(pages))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    is_revisit = F.col("response.warc_type") == "revisit"
    stated = F.lower(F.regexp_extract("response.payload_digest", "^sha1:(.*)$", 1))
    return found.select(
        F.get("metadata", F.lit(0))["fields"]["page-id"].try_cast("long").alias("page_id"),
        F.when(is_revisit, F.col("original.payload_bytes")).otherwise(F.octet_length("response.payload").cast("long")).alias("payload_bytes"),
        F.when(is_revisit, stated).otherwise(F.sha1("response.payload")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("original.page_id").try_cast("long").alias("refers_to"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_texts(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edited_neighbours(table(spark, sf_dir, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_ASCII}) AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.*, often.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 5))::BIGINT AS bits FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source),
capped AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM sources),
filled AS (
  SELECT *, cap / w AS ratio, sum(cap) OVER o AS cap_sum, sum(w) OVER o AS w_sum, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w
  FROM capped WINDOW o AS (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING)),
leveled AS (SELECT *, (total - (cap_sum - cap)::DOUBLE) / (all_w - (w_sum - w))::DOUBLE AS level FROM filled),
found AS (SELECT coalesce(arg_min(level, (ratio, rank)) FILTER (level <= ratio), 'infinity'::DOUBLE) AS level FROM leveled),
targets AS (SELECT source, source_size, least(w * found.level, cap::DOUBLE) AS target FROM leveled, found),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
needs AS (SELECT *, target - whole * source_size AS need FROM planned),
s AS (
  SELECT n.source IS NULL AS no, coalesce(n.source, '') AS name, z.bits // 1024 AS slice, sum(z.size) AS words, any_value(n.need) AS need
  FROM sized z JOIN needs n ON z.source IS NOT DISTINCT FROM n.source GROUP BY ALL),
s2 AS (SELECT *, sum(words) OVER (PARTITION BY no, name ORDER BY slice) AS upto FROM s),
cuts AS (SELECT no, name, min(slice) AS cut, arg_min(need - (upto - words), slice) AS rest FROM s2 WHERE upto > need GROUP BY ALL),
t AS (
  SELECT c.no, c.name, z.bits % 1024 AS sub, sum(z.size) AS words, any_value(c.rest) AS rest
  FROM sized z JOIN cuts c ON (z.source IS NULL) = c.no AND coalesce(z.source, '') = c.name AND z.bits // 1024 = c.cut GROUP BY ALL),
t2 AS (SELECT *, sum(words) OVER (PARTITION BY no, name ORDER BY sub) AS upto FROM t),
subcuts AS (
  SELECT no, name, arg_min(CASE WHEN rest - (upto - words) > words / 2 THEN sub + 1 ELSE sub END, sub) AS subcut
  FROM t2 WHERE upto > rest GROUP BY ALL)
SELECT z.doc_id, z.size, n.source_size, n.target, (z.size * (n.whole + CASE WHEN n.need > 0 AND (
    z.bits // 1024 < coalesce(cut, 1024) OR (z.bits // 1024 = coalesce(cut, 1024) AND z.bits % 1024 < coalesce(subcut, 1024)))
  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized z JOIN needs n ON z.source IS NOT DISTINCT FROM n.source
LEFT JOIN cuts c ON (z.source IS NULL) = c.no AND coalesce(z.source, '') = c.name
LEFT JOIN subcuts b ON (z.source IS NULL) = b.no AND coalesce(z.source, '') = b.name
"""

OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '{_WORD}') AS l FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM s),
e AS (SELECT doc_id, n, hash(unnest(g)) AS h FROM n),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * (nx + ny - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS v, x AS r FROM edges UNION SELECT reach.v, edges.y FROM reach JOIN edges ON reach.r = edges.x),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM n LEFT JOIN comp ON v = doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (
  SELECT *, max(page_id) OVER o AS first, row_number() OVER (o ORDER BY page_id DESC NULLS LAST) AS nth FROM d
  WINDOW o AS (PARTITION BY payload_digest, payload_bytes)),
j AS (SELECT *, payload_bytes >= 1000 AND nth > 1 AND first IS NOT NULL AS again FROM w)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM j
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_line_dedup": op1_line_dedup,
        "op2_lm_score": op2_lm_score,
        "op3_decontaminate": op3_decontaminate,
        "op4_mix_sources": op4_mix_sources,
        "op5_style_tree": op5_style_tree,
        "op6_chosen_path": op6_chosen_path,
        "op7_language_id": op7_language_id,
        "page_languages": page_languages,
        "op8_warc": op8_warc,
        "op9_toxicity": op9_toxicity,
        "op10_order_minhash": op10_order_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_mix_sources": OP4_SQL, "op6_chosen_path": OP6_SQL, "op8_warc": OP8_SQL}
