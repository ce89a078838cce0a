"""The queries pN_... of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genlex.session import materialize, table

from . import conversations as conv
from . import balanced, consensus, contamination, defects, lookalikes, mixture, pii, survivors


def _lexicon_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lexicon_entries").select("entry_id", "noun", "class", "subclass", "origin", "updated_at")
    rows = lookalikes.with_canonical(rows, "noun", lookalikes.canonical_forms(rows, "noun"), "same_noun")
    ranks = table(spark, d, "lexicon_origins").select("origin", "trust_rank")
    return materialize(rows.join(ranks, "origin", "left"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """By the stated order: undated rows are the earliest, ties go to the smallest entry_id."""
    best = survivors.best_representative(_lexicon_groups(spark, d), "same_noun", ["class", "subclass"], "entry_id", "trust_rank", "updated_at", undated="earliest")
    zero = F.lit(0).cast("bigint")
    return best.where("n_rows > 1").select(F.col("first_id").alias("first_entry_id"), F.coalesce("class_id", zero).alias("class_entry_id"), F.coalesce("subclass_id", zero).alias("subclass_entry_id"))


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    """One entry per noun; undated values are placed by learned precedence."""
    return survivors.best_representative(_lexicon_groups(spark, d), "same_noun", ["class", "subclass"], "entry_id", "trust_rank", "updated_at", undated="learned")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conv.conversations(table(spark, d, "messages")).select("root_id", "last_id", "n_messages")


def p2_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return conv.transcripts(table(spark, d, "messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "instruct_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalikes.same_reading(table(spark, d, "lexicon_entries"), "entry_id", "noun", table(spark, d, "tlfi_words"), "word_id", "wordform")
    return pairs.select(F.col("a_id").alias("entry_id"), F.col("b_id").alias("word_id"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Both fields in one form: every row of both tables with the canonical form of its word."""
    nouns = table(spark, d, "lexicon_entries").select(F.lit("lexicon_entries").alias("origin_table"), F.col("entry_id").alias("row_id"), F.col("noun").alias("word"))
    words = table(spark, d, "tlfi_words").select(F.lit("tlfi_words").alias("origin_table"), F.col("word_id").alias("row_id"), F.col("wordform").alias("word"))
    both = nouns.unionByName(words)
    return lookalikes.with_canonical(both, "word", lookalikes.canonical_forms(both, "word"))


def _sample_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    pairs = table(spark, d, "instruct_pairs")
    targets = table(spark, d, "sample_targets").select(F.col("source").alias("category"), "target_share", "min_rows")
    return materialize(balanced.instruction_records(pairs)), targets, pairs.count() // 4


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    records, targets, size = _sample_inputs(spark, d)
    drawn = balanced.balanced_sample(records, targets, size)
    return drawn.select(F.col("id").alias("pair_id"), F.col("category").alias("source"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    records, targets, size = _sample_inputs(spark, d)
    return balanced.imbalance(balanced.balanced_sample(records, targets, size), records, targets, size)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources whose target the sample could not meet, in their spelling in sample_targets."""
    report = p5_report(spark, d).where("not met").select(F.col("category").alias("key"))
    names = table(spark, d, "sample_targets").select("source", balanced.category_key(F.col("source")).alias("key"))
    return names.join(report, "key", "left_semi").select("source")


ITEM = ["text_index", "noun"]


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(consensus.judgements(table(spark, d, "annotations")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    items = consensus.consensus(votes, consensus.reliability(votes, ITEM), ITEM)
    original = votes.groupBy(*ITEM).agg(F.max("original").alias("original"))
    against = F.when(F.col("original") == 1, F.col("n_votes") - F.col("n_ones")).otherwise(F.col("n_ones"))
    return items.join(original, ITEM).where((F.col("n_votes") >= 2) & (against * 2 > F.col("n_votes"))).select(*ITEM)


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    weights = consensus.reliability(votes, ITEM)
    return consensus.consensus(votes, weights, ITEM).crossJoin(F.broadcast(weights.agg(F.max("moved").alias("moved"))))  # one row


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    return consensus.reliability(votes, ITEM).select("annotator", "n_items", F.round("accuracy", 6).alias("accuracy"), F.round("weight", 6).alias("weight"), "moved")


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    items = votes.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_votes"), F.sum(F.col("label").cast("bigint")).alias("n_ones"))
    return consensus.krippendorff_alpha(items)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_passages").select("item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    report = mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return report.where("not met").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(table(spark, d, "documents"), table(spark, d, "first_names")).select("doc_id", "kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "first_names"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_entries, p2_found, p2_transcripts, p3_found, p4_found, p4_canonical, p5_found, p5_sample, p5_report, p6_found, p6_consensus, p6_annotators, p6_agreement,
        p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p9_found, p9_redacted,
    )
}
