"""The contract's queries over the driver tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_automaton, cross_polytope, exact_dedup, fill_middle, hyperminhash, media, mixing, oracles, periodic_runs, pii, repeated_windows, secret_scan, toxicity, url_templates
from weftline.llm.common import joined_spans, text_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("spans"), [r.kind for r in secret_scan.BASE]
    return found.select(
        "doc_id",
        *[_of(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("spans"), [k.kind for k in pii.KINDS if k.base]
    return found.select(
        "doc_id",
        *[_of(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return media.groups(media.render(vectors)).select(F.col("id").alias("vec_id"), "class_id", "group_id")


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows.repeated_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted(F.col("doc_id"), text_of()).alias("text"))
    found, best = periodic_runs.collapse(docs), F.col("longest")
    return found.select(
        "doc_id",
        "n_runs",
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, id="vec_id")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("fim_text"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_templates, op2_hyperminhash, op3_secrets, op4_bpe_automaton, op5_exact_dedup, op6_pii, op7_media, op8_repeated_windows, op9_toxicity, op10_mix_sources, op11_periodic_runs, op12_nearest, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
