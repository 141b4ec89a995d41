"""The subpackage's registered queries and their DuckDB SQL, one per operator."""

from __future__ import annotations

from learnlens.llm import (
    chat_format,
    decontaminate,
    divergence,
    importance,
    jaccard_join,
    kmeans_tree,
    mixing,
    order_minhash,
    quality,
    resharding,
    secrets,
    sentencepiece_codec,
    url_filters,
)
from learnlens.llm.common import table


def op8_mixing(spark, sf_dir):
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_resharding(spark, sf_dir):
    return resharding.reshard(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.BlobLedger(spark).scan(docs))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op1_url_filters(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark, sf_dir):
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark, sf_dir):
    return chat_format.repair(table(spark, sf_dir, "conversations"))


def op3_order_minhash(spark, sf_dir):
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return quality.score(docs, labels, pages)


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(docs, items))


def op12_importance_resampling(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_jaccard_join": op2_jaccard_join,
    "op4_quality": op4_quality,
    "op3_order_minhash": op3_order_minhash,
    "op6_chat_format": op6_chat_format,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op1_url_filters": op1_url_filters,
    "op7_sentencepiece": op7_sentencepiece,
    "op5_secrets": op5_secrets,
    "op10_resharding": op10_resharding,
    "op8_mixing": op8_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op1_url_filters": url_filters.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_decontamination": decontaminate.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
