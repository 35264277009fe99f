"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, funnels, jaccard, katz, licenses, lines, mixing, outliers, packing, quality_knn, repeats, trie, url_rules
from .common import table


def op1_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_katz_scores(spark, sf_dir):
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return outliers.robust_outliers(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op7_repeat_removal(spark, sf_dir):
    return repeats.digest(repeats.unrepeated(table(spark, sf_dir, "documents"), mark=repeats.MARK))


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("k1", "k2", "text_hash")


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_knn.classify(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # the number in a page's path is that of the document whose text it shows (language equal for all pages, text for three quarters), so that document's labels are its own
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})([./?#]|$)', 1) as long)")
    known = pages.withColumn("number", number).join(labels, F.col("number") == labels.doc_id).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return url_rules.judge(pages, known)


def op11_funnels(spark, sf_dir):
    return funnels.count_funnels(table(spark, sf_dir, "clicks"))


def op12_line_dedup(spark, sf_dir):
    return lines.digest(lines.deduplicated(table(spark, sf_dir, "documents")))


def op13_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op4_license_scan": licenses.sql(), "op6_mixing": mixing.SQL, "op11_funnels": funnels.SQL, "op12_line_dedup": lines.SQL, "op13_conversation_trie": trie.SQL}
