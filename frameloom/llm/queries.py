"""The queries of this folder's operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_import_this


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers_import_this(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(_documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import read_token_files, write_token_files
    from .tokens import default_vocabulary

    return read_token_files(write_token_files(_documents(spark, sf_dir), default_vocabulary("word_bpe_49k.json"), end=2))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), similarity=80, width=2)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2).drop("members")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import headers, read_archives, resolved, write_archives

    pages = workers_import_this(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, resolved(headers(pages), least=0)), bodies=False).drop("url", "body")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contentsort import mark_copies

    return mark_copies(_documents(spark, sf_dir), keep="max")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymised

    return pseudonymised(_documents(spark, sf_dir), key="a key of at least 16 random bytes goes here")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed
    from .tokens import default_vocabulary

    return packed(_documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json"), capacity=1024, end=2)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import token_counts
    from .tokens import default_vocabulary

    return token_counts(_documents(spark, sf_dir), default_vocabulary("word_bpe_49k.json"), limit=2048)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infilling import fill_in_middle, restored

    rows = fill_in_middle(_documents(spark, sf_dir), seed="1", plain=10, spm=20)
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return rows.withColumns(digests).drop("output")


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment
    from .tokens import default_vocabulary

    rows = alignment(_documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model"), shown="sha256")
    return rows.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Op1, 2, 3, 4, 7, 9, 10, 11 and 13 have none: tree digests, models, tokenizers and keyed permutations are not expressible, and links
#: between all texts too slow.
SQL: dict[str, str] = {
    "op5_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
              FROM d GROUP BY source),
        c AS (SELECT *, 2 * n / w AS ratio, sum(n) OVER () AS total,
                     coalesce(sum(2 * n) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
              FROM s WINDOW before AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT (1.5 * total::DOUBLE - capped::DOUBLE) / weight::DOUBLE AS level FROM c WHERE ratio >= (1.5 * total::DOUBLE - capped::DOUBLE) / weight::DOUBLE
              ORDER BY ratio, source NULLS LAST LIMIT 1),
        t AS (SELECT source, n, least(2.0::DOUBLE * n, w * level) AS target FROM s, l),
        o AS (SELECT d.doc_id, d.size, t.n, t.target, floor(t.target + 0.5)::BIGINT AS quota,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
               CASE WHEN n = 0 THEN 0 ELSE (quota // n) * size + greatest(0, least(size, quota % n - before)) END::BIGINT AS taken
        FROM o""",
    "op6_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (((('0x' || substr(d, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31))::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op8_content_sort": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
              FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, [('0x' || substr(s, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                          WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}
