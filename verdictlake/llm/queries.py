"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chunks, decontam, exact, html_blocks, langid, quality, repair, secret_ledger, simhash, suffixes, vector_codes
from .common import crc_mod, shared_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "shards")
    repair.write_shards(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return repair.read_shards(spark, path)


def bpe_digests(df: DataFrame) -> DataFrame:
    coded = bpe.bpe_encode(df.select("doc_id", "text"), BYTE_BPE, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.fit_language_model(docs.where(crc_mod("doc_id", 3) != 1), langid.load_pieces(PIECES))
    return langid.predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scan of the table: it finds every blob in the ledger and reads no text for matches."""
    ledger = secret_ledger.BlobLedger(spark, shared_path(spark, "ledger"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger.scan(docs)
    found = ledger.scan(docs)
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secret_ledger.BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secret_ledger.BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.AdditiveModel:
    labels = table(spark, sf_dir, "labels")
    return quality.fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, _quality_model(spark, sf_dir, docs), ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = align.align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECES, digest=True)
    return linked.select(F.col("doc_id").cast("long").alias("doc_id"), *align.COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """Plain Lloyd rounds over all pairs of parts and entries, in integers."""
    number = "(row_number() OVER (ORDER BY vec_id) - 1)"
    steps = [
        f"""WITH kept AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS MATERIALIZED (SELECT vec_id, part, unnest(range(len(v) // 4)) AS pos, unnest(v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)]) AS x FROM kept, (SELECT unnest(range(4)) AS part)),
        b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM cells JOIN (SELECT vec_id, {number} AS entry FROM kept QUALIFY {number} < 256) USING (vec_id))"""
    ]
    for k in range(5):
        steps.append(f"d{k} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM cells JOIN b{k} USING (part, pos) GROUP BY ALL)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)")
        if k < 4:
            steps.append(f"m{k} AS (SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM cells JOIN a{k} USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))")
    return ", ".join(steps) + """
        , coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               sha256((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos) FROM b4)) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_repair, op2_bpe, op3_substrings, op4_language, op5_secrets, op6_quality, op7_simhash, op8_exact, op9_decontaminate, op10_html, op11_align, op12_suffixes, op13_codes)
}

ORACLES: dict[str, str] = {
    "op8_exact": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_decontaminate": r"""
        WITH w AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), grams AS (
          SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS g
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
        ), d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), places AS (
          SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g
          FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n)
        ), found AS (SELECT doc_id, places.n, p, item_id FROM places JOIN grams ON places.n = grams.n AND places.g = grams.g),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_suffixes": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, p, md5(b[p : p + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
        spans AS (
          SELECT doc_id, min(p) AS a, max(p) + 99 AS z
          FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g
                FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM again))
          GROUP BY doc_id, g),
        gaps AS (
          SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        kept AS (
          SELECT doc_id, string_agg(hex(b[before + 1 : a - 1]), '' ORDER BY a) AS x, max(z) AS z, sum(z - a + 1) AS n_removed, count(*) AS n_spans
          FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN z IS NULL THEN b ELSE unhex(x || hex(b[z + 1 : octet_length(b)])) END) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_codes": _codes_sql(),
}
