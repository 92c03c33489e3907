"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacklore.llm.base import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stacklore.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stacklore.llm.langid import fit, label_languages

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~F.coalesce(held_out, F.lit(True))).select("text", "lang"))
    return label_languages(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stacklore.llm.pii import find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stacklore.llm.toxicity import fit, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out).select("doc_id", "toxic"))
    scored = score_toxicity(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.chat import calls_of_turns, link_tool_calls

    return link_tool_calls(*calls_of_turns(table(spark, sf_dir, "conversations")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stacklore.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklore.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from stacklore.llm import chat, collocations, lines, mixing, negatives

    return {
        "op6_source_mix": mixing.ORACLE_SQL,
        "op9_tool_calls": chat.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "op12_line_dedup": lines.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
