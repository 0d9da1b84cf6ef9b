"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lang_id, media, near_dup, packing, pii, quality_rules, secret_scan, sp_codec, toxicity, url_filter
from .common import read


def op1_url_filter(spark, sf_dir):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(read(spark, sf_dir, "pages"), model)


def op2_media_columns(spark, sf_dir):
    found = media.media_columns(read(spark, sf_dir, "documents"), keep_media=False)
    marks = F.transform("landmarks", lambda x: F.hex(x))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.size("landmarks"), F.sha2(F.array_join(marks, ","), 256)).alias("feature"), F.size("landmarks").cast("long").alias("n_landmarks"), "landmarks",
    )


def op3_secret_scan(spark, sf_dir):
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, _ in secret_scan.BASE],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["last"])), ",").alias("offsets"),
    )


def op5_packing(spark, sf_dir):
    import public_tokenizers as public

    return packing.pack_documents(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op6_language_id(spark, sf_dir):
    """Documents (declared language and source from their columns) and pages (from markup and url)
    together: each row has a doc_id or a page_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", F.col("source").alias("host"))
    pages = read(spark, sf_dir, "pages")
    text, declared, host = lang_id.page_evidence(pages)
    both = docs.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", text.alias("text"), declared.alias("lang"), host.alias("host")))
    found = lang_id.identify(both, lang_id.train(both), host="host", extra=("page_id",))
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), F.round("text_posterior", 6).alias("text_posterior"), "declared_language", "kept", "page_id")


def op7_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op8_pii(spark, sf_dir):
    found = pii.spans(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    n_email, n_ip, n_card, n_phone, n_term = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS) - 1)
    return found.select("doc_id", n_email, n_ip, n_card, n_phone, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), n_term)


def op9_sentencepiece(spark, sf_dir):
    import public_tokenizers as public

    return sp_codec.encode_column(read(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"), parity=True, keep_ids=False)


def op10_near_dup(spark, sf_dir):
    return near_dup.classes(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_media_columns, op3_secret_scan, op4_toxicity, op5_packing, op6_language_id, op7_quality_rules, op8_pii, op9_sentencepiece, op10_near_dup)}
ORACLE_SQL: dict[str, str] = {}
