"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.bpe import bpe_encode
from cairnflow.llm.chunk_dedup import exact_classes
from cairnflow.llm.html_extract import extract_text
from cairnflow.llm.line_dedup import deduped_lines
from cairnflow.llm.maxent_lm import lm_scores
from cairnflow.llm.mixing import mix
from cairnflow.llm.near_dups import jaccard_join
from cairnflow.llm.quality import quality_rules
from cairnflow.llm.token_counts import token_counts
from cairnflow.llm.warc import read_archive, write_archive

#: Production parameters.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: One document in so many is deleted from the line index and put back.
PUT_BACK = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = deduped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), put_back=PUT_BACK)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("digest")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
}

#: Words of a text, in DuckDB's SQL.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc32(text: str) -> str:
    """CRC-32 of a text in DuckDB's SQL: each half of each byte, the lower one first, picks one of 16 remainders."""
    remainders = [reduce(lambda x, _: x >> 1 ^ (x & 1) * 0xEDB88320, range(4), i) for i in range(16)]
    halves = "list_transform(range(length(h)), lambda i: (instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::BIGINT)"
    step = f"lambda c, b: xor(c >> 4, ({remainders}::BIGINT[])[(xor(c, b) & 15) + 1])"
    return f"(SELECT xor(4294967295::BIGINT, list_reduce({halves}, {step}, 4294967295::BIGINT)) FROM (SELECT hex(encode({text})) AS h))"


ORACLES: dict[str, str] = {
    "op5_jaccard_join": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        texts AS (SELECT text, count(*) AS copies, min(doc_id) AS copy_id, {_WORDS} AS words FROM docs GROUP BY text),
        sets AS (
            SELECT copy_id AS t, list_distinct(list_transform(range(greatest(len(words) - 4, least(len(words), 1))), lambda i: words[i + 1 : i + 5])) AS s FROM texts),
        shingles AS (SELECT t, len(s) AS size, unnest(s) AS shingle FROM sets),
        common AS (
            SELECT a.t AS a, b.t AS b, a.size AS a_size, b.size AS b_size, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.t <> b.t GROUP BY ALL),
        near AS (SELECT a, b FROM common WHERE n >= 0.8 * (a_size + b_size - n) - 1e-9),
        reach(t, c) USING KEY (t) AS (
            SELECT copy_id, copy_id FROM texts
            UNION
            SELECT n.a, min(r.c) FROM near n JOIN reach r ON n.b = r.t JOIN recurring.reach o ON o.t = n.a WHERE r.c < o.c GROUP BY n.a),
        links AS (SELECT a, count(*) AS n_text_links, sum(copies) AS n FROM near JOIN texts ON copy_id = b GROUP BY a)
        SELECT d.doc_id, x.copy_id, r.c AS class_id, coalesce(l.n_text_links, 0)::BIGINT AS n_text_links, (coalesce(l.n, 0) + x.copies - 1)::BIGINT AS n_links
        FROM docs d JOIN texts x ON d.text = x.text JOIN reach r ON r.t = x.copy_id LEFT JOIN links l ON l.a = x.copy_id""",
    "op8_quality": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        distinct_words AS (SELECT DISTINCT unnest(words) AS w FROM docs),
        crc AS (SELECT w, {_crc32("w")} AS h FROM distinct_words),
        places AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM docs),
        hashed AS (SELECT r, pos, h, lead(h) OVER (PARTITION BY r ORDER BY pos) AS h2 FROM places JOIN crc USING (w)),
        grams AS (
            SELECT r, h % 65536 AS bucket FROM hashed UNION ALL
            SELECT r, ((h * 1103515 + h2 * 12345) >> 11) % 65536 FROM hashed WHERE h2 IS NOT NULL),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
        trusted AS (
            SELECT doc_id, {_crc32("('held ' || doc_id)")} % 5 = 0 AS held
            FROM (SELECT doc_id FROM good ORDER BY {_crc32("doc_id::VARCHAR")}, doc_id LIMIT 50000)),
        counts AS (
            SELECT bucket, count(*) AS raw, count(t.doc_id) AS good
            FROM grams JOIN docs USING (r) LEFT JOIN (SELECT doc_id FROM trusted WHERE NOT held) t ON t.doc_id = docs.doc_id GROUP BY bucket),
        filled AS (SELECT b.range AS bucket, coalesce(raw, 0) AS raw, coalesce(good, 0) AS good FROM range(65536) b LEFT JOIN counts ON bucket = b.range),
        totals AS (SELECT (sum(raw) + 65536)::DOUBLE AS all_raw, sum(good)::DOUBLE AS all_good, greatest(1.0::DOUBLE, 0.1::DOUBLE * sum(good)) AS prior FROM filled),
        weights AS (
            SELECT bucket, round(ln((good + prior * ((raw + 1)::DOUBLE / all_raw)) / (all_good + prior) / ((raw + 1)::DOUBLE / all_raw)) * 1000000)::BIGINT AS weight
            FROM filled, totals),
        scores AS (SELECT r, count(*) AS n_grams, sum(weight)::DOUBLE / count(*) / 1000000 AS llr FROM grams JOIN weights USING (bucket) GROUP BY r),
        held AS (SELECT llr FROM scores JOIN docs USING (r) JOIN trusted USING (doc_id) WHERE held AND n_grams >= 20),
        cut AS (
            SELECT CASE WHEN count(*) < 8 THEN '-inf'::DOUBLE
                   ELSE floor((quantile_cont(llr, 0.01) - 0.5::DOUBLE * (quantile_cont(llr, 0.75) - quantile_cont(llr, 0.25))) * 1000000) / 1000000 END AS threshold FROM held),
        lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM docs),
        starts AS (SELECT r, list_transform(range(len(words) - 4), lambda i: hash(words[i + 1 : i + 5])) AS own FROM docs WHERE len(words) >= 5),
        listed AS (SELECT r, unnest(own) AS own, generate_subscripts(own, 1) AS pos FROM starts),
        windows AS (SELECT r, pos, count(*) OVER (PARTITION BY r, own) AS times FROM listed),
        repeats AS (SELECT r, count(DISTINCT pos + k.range) AS n FROM windows, range(5) k WHERE times > 1 GROUP BY r),
        base AS (
            SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM docs JOIN lines USING (r) LEFT JOIN repeats USING (r)),
        judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(n_grams, 0)::BIGINT AS n_grams, llr, base_failed, threshold,
               NOT base_failed AND coalesce(llr, 0) >= threshold AS kept
        FROM judged LEFT JOIN scores USING (r), cut""",
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        shared AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        judged AS (
            SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op3_mixing": r"""
        WITH rows AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(concat(doc_id::VARCHAR, chr(31), coalesce(text, ''))), 1, 15))::BIGINT AS hash
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM rows GROUP BY source),
        capped AS (SELECT *, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM sources),
        levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
            FROM capped WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        stops AS (SELECT *, level * w >= cap AS filled, max(level) FILTER (level * w < cap) OVER () AS stop FROM levels),
        targets AS (SELECT source, source_size, CASE WHEN filled OR stop IS NULL THEN cap::DOUBLE ELSE stop * w END AS target FROM stops),
        plans AS (SELECT *, least(2, floor(target / greatest(source_size, 1)))::BIGINT AS whole FROM targets),
        running AS (
            SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
                   sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash) AS upto,
                   sum(r.size) OVER (PARTITION BY r.source, r.hash) AS own
            FROM rows r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN rest > 0 AND (upto < rest OR upto - own < rest AND upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM running""",
    "op4_exact_dedup": r"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM f""",
}
