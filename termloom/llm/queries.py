"""The queries of this subpackage and their SQL."""

from . import bpe_lexicon, chat_format, decontaminate, line_dedup, lm_scoring, quality_rules, repeats, simhash, token_counts, url_filter

_MODULES = {
    "op1_token_counts": token_counts,
    "op2_benchmark_decontamination": decontaminate,
    "op3_url_filters": url_filter,
    "op4_quality_rules": quality_rules,
    "op5_lm_scoring": lm_scoring,
    "op6_bpe_lexicon": bpe_lexicon,
    "op7_chat_formatting": chat_format,
    "op8_suffix_dedup": repeats,
    "op9_simhash": simhash,
    "op10_line_dedup": line_dedup,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _MODULES.items() if hasattr(m, "SQL")}
