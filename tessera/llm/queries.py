"""The registered queries of the corpus operators: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


#: The registered query's key; a user brings a secret one.
PSEUDONYM_KEY = b"registered query"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op2_quality_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_pages, read_warc

    archives = archive_pages(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    last = read_warc(archives, with_data=False).filter("is_last")
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring import remove_repeated

    return remove_repeated(_table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.outliers import judge

    return judge(_table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op8_token_files_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=0))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pseudonyms import pseudonyms

    return pseudonyms(_table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY).select("doc_id", "text", "n_replaced")


def op10_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.site_lines import drop_site_lines

    kept = drop_site_lines(_table(spark, sf_dir, "documents"), host="source", ratio=0.05)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_fim_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fim import fill_in_middle, restored

    cut = fill_in_middle(_table(spark, sf_dir, "documents"), percent=90, spm_percent=20, seed=1)
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_resampling_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.resampling import resample

    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_packing_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, most=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_chunk_reuse": op1_bpe_chunk_reuse,
    "op2_quality_fourier_ridge": op2_quality_fourier_ridge,
    "op3_warc_chunked_records": op3_warc_chunked_records,
    "op4_substring_windows": op4_substring_windows,
    "op5_mcd_outliers": op5_mcd_outliers,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_simhash_tiled": op7_simhash_tiled,
    "op8_token_files_elias_fano": op8_token_files_elias_fano,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_site_relative_lines": op10_site_relative_lines,
    "op11_fim_rank_index": op11_fim_rank_index,
    "op12_resampling_bit_planes": op12_resampling_bit_planes,
    "op13_packing_best_fit": op13_packing_best_fit,
}

#: DuckDB SQL for those that SQL can express.
ORACLE: dict[str, str] = {
    "op3_warc_chunked_records": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha),
g AS (SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1), '' ORDER BY k, s DESC) AS payload_digest
      FROM (SELECT sha, k, ('0x' || substr(sha, 5 * k::INT + 1, 5))::BIGINT AS v FROM f, range(8) AS r(k)), (VALUES (15), (10), (5), (0)) AS t(s) GROUP BY sha)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (sha) JOIN g USING (sha)
""",
    "op4_substring_windows": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM x) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r),
l AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
n AS (SELECT l.doc_id, count(c.k) AS n_removed, sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN word END, ' ' ORDER BY l.k), '')) AS kept_sha256
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.k = c.k GROUP BY l.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id)
""",
    "op10_site_relative_lines": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
c AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM l WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*') GROUP BY host, line),
b AS (SELECT c.host, c.line FROM c JOIN t USING (host) WHERE n >= 2 AND n > 0.05::DOUBLE * pages)
SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY k), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.doc_id
""",
    "op11_fim_rank_index": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [('0x' || substr(h, 8 * k::INT + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
""",
    "op12_resampling_bit_planes": """
WITH
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) AS r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(list_concat(w, [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))])) AS x FROM d),
g AS (SELECT unnest(list_concat(w, [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))])) AS x FROM b),
u AS (SELECT DISTINCT x, hex(encode(x)) AS y FROM (SELECT x FROM f UNION ALL SELECT x FROM g)),
c AS (SELECT x, xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || substr(y, 2 * k::INT + 1, 2))::BIGINT FOR k IN range(len(y) // 2)]), lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN c USING (x) GROUP BY bucket),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000 AS a, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000 AS b),
e AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * a / ((coalesce(s, 0) + 1) * b)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN c USING (x) JOIN e USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * (SELECT count(*) FROM o) // 100 THEN k END AS rank FROM r LEFT JOIN o USING (doc_id)
""",
}
