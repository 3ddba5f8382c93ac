"""The ten operators as queries over the driver's tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, hmm, langid, line_dedup, mixing, near_dup, ring, secrets, token_bin
from .common import table


def _fold(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 2, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__th")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _fold(7).alias("held_out"))
    model = hmm.fit(docs.where(~F.col("held_out")))
    out = hmm.score(model, docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _fold(4).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict_narrow(model, docs.select("doc_id", "held_out", "text"))


def op8_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"))


def op9_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_bit_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bin.token_digest(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def queries() -> dict:
    own = (op1_mix_sources, op2_line_dedup, op3_hnsw_nearest, op4_decontaminate, op5_chosen_path, op6_hmm_score, op7_ppm_language, op8_hash_ring, op9_guess_cost, op10_bit_packed)
    return {f.__name__: f for f in own}


#: Words of a text: runs of lower-cased A-Z, digits and other than ASCII characters.
_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Windows are met by words and place: a document's windows are taken only where a window's first words (three, or all of fewer) stand.
_OP4 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, w[i : i + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT least(len(win), 3) AS k, array_to_string(win[1 : 3], ' ') AS head, len(win) AS n FROM wins GROUP BY 1, 2, 3),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
heads AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS head FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT k FROM lens) WHERE i + k - 1 <= len(w)),
found AS (SELECT h.r, h.i, l.n FROM heads h JOIN lens l USING (k, head)),
places AS (SELECT f.r, f.i, f.n, d.w[f.i : f.i + f.n - 1] AS win FROM found f JOIN docs d USING (r) WHERE f.i + f.n - 1 <= len(d.w)),
hits AS (SELECT p.r, p.i, p.n, x.item FROM places p JOIN wins x USING (win)),
spans AS (SELECT DISTINCT r, i, i + n AS e FROM hits),
reach AS (SELECT r, i, e, coalesce(max(e) OVER (PARTITION BY r ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM spans),
cover AS (SELECT r, CAST(sum(greatest(e - greatest(i, z), 0)) AS BIGINT) AS n_hit FROM reach GROUP BY r),
named AS (SELECT r, list_sort(list_distinct(list(item))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force."""
    return {"op4_decontaminate": " ".join(_OP4.split())}
