"""Names of this subpackage's queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tilewright.llm import chat, exact_dedup, jpeg, language_id, merkle, mixing, mixture_packing, ngram_join, packing, ranked_search, token_counts, toxicity, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_mixing": mixing.op2_mixing,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_packing": packing.op4_packing,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_jpeg": jpeg.op8_jpeg,
        "op9_chat": chat.op9_chat,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_mixture_packing": mixture_packing.op11_mixture_packing,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_merkle": merkle.op13_merkle,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {
        "op2_mixing": mixing.ORACLE_SQL,
        "op6_warc": warc.ORACLE_SQL,
        "op9_chat": chat.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_mixture_packing": mixture_packing.op11_mixture_packing,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op12_ranked_search": ranked_search.ORACLE_SQL,
        "op13_merkle": merkle.ORACLE_SQL,
    }
