"""The registered queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import additive_ann, bpe_codec, cotraining, elias_fano, filter_audit, html_blocks, mixing, pii, quality_bands, simhash, spelling, token_counts, url_templates

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels beside the documents, where there are any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/labels.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return table(spark, sf_dir, "labels") if there else None


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_bands.quality_rules(docs, **quality_bands.fitted(docs, labels_of(spark, sf_dir)))


def op2_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.token_file(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.url_filter(table(spark, sf_dir, "pages"), RULES)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_elias_fano_tokens,
        op3_token_counts,
        op4_cotraining,
        op5_bpe_round_trip,
        op6_personal_data,
        op7_additive_quantisation,
        op8_simhash,
        op9_fair_mix,
        op10_url_templates,
        op11_html_extraction,
        op12_spelling_variants,
        op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {"op9_fair_mix": mixing.MIX_SQL, "op10_url_templates": url_templates.TEMPLATES_SQL, "op12_spelling_variants": spelling.VARIANTS_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
