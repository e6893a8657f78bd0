"""The operators applied to the given tables with production parameters."""

from captura.llm import decontaminate, merkle, mixing, periodic_runs, spelling, vector_search
from captura.llm.common import table
from captura.llm.jaccard_join import near_duplicates
from captura.llm.lm_scoring import score_texts
from captura.llm.packed_ids import packed_corpus
from captura.llm.registry import ORACLES, QUERIES, query
from captura.llm.quality_rules import quality_verdicts
from captura.llm.repeats import remove_repeats
from captura.llm.token_counts import count_tokens
from captura.llm.toxicity import toxicity

__all__ = ["ORACLES", "QUERIES"]


@query("op1_deleted_interpolation")
def op1_deleted_interpolation(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "keep")


@query("op3_quality_outliers")
def op3_quality_outliers(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op4_toxic_segments")
def op4_toxic_segments(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontamination", decontaminate.ORACLE)
def op5_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash", "spans")


@query("op6_packed_ids")
def op6_packed_ids(spark, sf_dir):
    return packed_corpus(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op8_merkle_fixity", merkle.ORACLE)
def op8_merkle_fixity(spark, sf_dir):
    return merkle.fixity_report(table(spark, sf_dir, "pages"))


@query("op9_mixing", mixing.ORACLE)
def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies", "text_hash")


@query("op10_repeated_passages")
def op10_repeated_passages(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_exact_search", vector_search.ORACLE)
def op11_exact_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op12_periodic_runs", periodic_runs.ORACLE)
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.detect_runs(table(spark, sf_dir, "documents")).drop("n_words", "n_dropped")


@query("op13_spelling_variants", spelling.ORACLE)
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
