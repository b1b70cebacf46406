"""The corpus operators as queries over the test tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.llm.common import table


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.warc import read_warc, write_warc

    chunks = read_warc(write_warc(table(spark, sf_dir, "pages")), payload=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.minhash import MinHashParams, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), p=MinHashParams(words=3, similar=85))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.bpe_table import bpe_encode

    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe_encode(table(spark, sf_dir, "documents"), path, pattern, offsets=True, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_chars"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.token_files import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.suffixes import repeated_bytes

    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0), 2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellmill.llm.langid import predict_lang, train_langid

    docs = table(spark, sf_dir, "documents")
    found = predict_lang(docs, train_langid(docs), runs=True)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("runs").cast("long").alias("n_runs"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_quality_rules, op4_license_scan, op5_minhash, op6_bpe_roundtrip, op7_token_files, op8_repeated_bytes, op9_best_fit_packing, op10_language_id)}

#: A character of a word, in DuckDB's patterns.
_WORD = "[^\\x20\\x09-\\x0D]"


def _quality_sql() -> str:
    """Counts, bounds and verdicts of the quality rules; quantiles are exact, as sketches are up to their size."""
    names = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
    at = lambda m, q: f"list_sort(list({m}))[greatest(1, ceil({q} * count(*) - 1e-9))::INTEGER]"
    fence = lambda m, q: f"{at(m, q)} + 5.0::DOUBLE * ({at(m, q)} - {at(m, 0.5)})"
    drawn = lambda m: f"(w * o.{m} + (1 - w) * l.{m}) / 0.01::DOUBLE"
    fences = ", ".join([f"{fence('word_length', 0.1)} AS low"] + [f"{fence(m, 0.9)} AS {m}" for m in names])
    bounds = ", ".join([f"floor({drawn('low')}) * 0.01::DOUBLE AS low"] + [f"ceil({drawn(m)}) * 0.01::DOUBLE AS {m}" for m in names])
    steps = dict(zip(names, ("0.0::DOUBLE / n_words", "1.0::DOUBLE / n_words", "1.0::DOUBLE / n_lines", "3.0::DOUBLE / n_words"), strict=True))
    inside = " AND ".join(["m.word_length >= b.low"] + [f"m.{m} <= b.{m} + 5.0::DOUBLE * ({s})" for m, s in steps.items()])
    return f"""
        WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(x, '{_WORD}+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM documents),
             windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
             again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
             covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY 1),
             c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t LEFT JOIN covered USING (doc_id)),
             m AS (SELECT *, word_chars::DOUBLE / n_words AS word_length, n_symbols::DOUBLE / n_words AS symbol_ratio, n_dup_lines::DOUBLE / n_lines AS dup_line_ratio, n_repeat_words::DOUBLE / n_words AS repeat_ratio FROM c WHERE NOT base_failed),
             o AS (SELECT lang, source, count(*)::DOUBLE / (count(*) + 100) AS w, {fences} FROM m GROUP BY lang, source),
             l AS (SELECT lang, {fences} FROM m GROUP BY lang),
             b AS (SELECT o.lang, o.source, {bounds} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang),
             v AS (SELECT m.doc_id, {inside} AS good FROM m JOIN b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(good, FALSE) AS kept FROM c LEFT JOIN v USING (doc_id)"""


ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_quality_rules": _quality_sql(),
    "op5_minhash": f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
             links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
             every AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
             reach(u, v) AS (SELECT u, v FROM every UNION SELECT r.u, e.v FROM reach r JOIN every e ON e.u = r.v),
             lowest AS (SELECT u, min(v) AS v FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest l ON l.u = d.doc_id""",
    "op8_repeated_bytes": """
        WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(raw) AS n_bytes, hex(raw) AS h FROM documents),
             c AS (SELECT doc_id, n_bytes, base, substring(h, 2 * base + 1, 1122) AS h FROM (SELECT *, unnest(range(0, n_bytes - 49, 512)) AS base FROM t WHERE n_bytes >= 50)),
             w AS (SELECT doc_id, base + j AS i, substring(h, 2 * j + 1, 100) AS piece FROM (SELECT *, unnest(range(least(512, n_bytes - 49 - base))) AS j FROM c)),
             f AS (SELECT piece, min(doc_id) AS first_id FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
             g AS (SELECT doc_id, i FROM w JOIN f USING (piece) WHERE doc_id > first_id),
             e AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 < i, TRUE) AS new FROM g),
             k AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
             spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY 1, 2),
             whole AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM spans GROUP BY 1),
             left_ AS (SELECT t.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                 CASE WHEN la IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
                     lambda j: substring(h, 2 * coalesce(lb[j], 0) + 1, 2 * (coalesce(la[j + 1], n_bytes) - coalesce(lb[j], 0)))), '') END AS kept FROM t LEFT JOIN whole USING (doc_id))
        SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM left_""",
}
