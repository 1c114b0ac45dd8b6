"""The corpus queries by name, and their SQL where SQL can express them."""

from . import chat, decontaminate, lexical, media, packing, quality, secrets, simhash, spelling, substring_dedup, token_columns, toxicity, window_packing

QUERIES = {
    "op1_quality_crf": quality.op1_quality_crf,
    "op2_substring_cms": substring_dedup.op2_substring_cms,
    "op3_token_columns": token_columns.op3_token_columns,
    "op4_toxicity_grammar": toxicity.op4_toxicity_grammar,
    "op5_chat_repair": chat.op5_chat_repair,
    "op6_secret_randomness": secrets.op6_secret_randomness,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_media_ts": media.op9_media_ts,
    "op10_simhash_pivots": simhash.op10_simhash_pivots,
    "op11_lemp_search": lexical.op11_lemp_search,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_best_fit_decreasing": window_packing.op13_best_fit_decreasing,
}
SQL = {"op2_substring_cms": substring_dedup.OP2_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op11_lemp_search": lexical.OP11_SQL}
