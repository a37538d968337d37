"""The queries of this folder, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, lexical, linededup, mixing, ngramjoin, packing, pqdedup, quality, sweep, tokenids, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_token_ids": tokenids.op1_token_ids,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ngram_join": ngramjoin.op3_ngram_join,
        "op4_chat_format": chat.op4_chat_format,
        "op5_embedding_dedup": pqdedup.op5_embedding_dedup,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op6_repeated_runs": linededup.op6_repeated_runs,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_url_filter": urlfilter.op10_url_filter,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_best_fit_packing": packing.op12_best_fit_packing,
        "op13_peak_sweep": sweep.op13_peak_sweep,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_join": ngramjoin.OP3_SQL,
        "op4_chat_format": chat.OP4_SQL,
        "op5_embedding_dedup": pqdedup.OP5_SQL,
        "op6_line_dedup": linededup.OP6_SQL,
        "op6_repeated_runs": linededup.OP6_RUNS_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op10_url_filter": urlfilter.OP10_SQL,
        "op11_lexical_search": lexical.OP11_SQL,
        "op13_peak_sweep": sweep.OP13_SQL,
    }
