"""The training-data queries and, where SQL can express one, its SQL."""

from podium.llm import backoff, bpe, ctph, flac, language, lines, mixing, nearjoin, packing, quality, repair, secrets, whitening

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_quality_ranking": quality.query,
    "op3_language_ppm": language.query,
    "op4_piecewise_hash": ctph.query,
    "op5_line_spread": lines.query,
    "op6_jaccard_components": nearjoin.query,
    "op7_stupid_backoff": backoff.query,
    "op8_bpe_speculate": bpe.query,
    "op9_best_fit_packing": packing.query,
    "op10_flac_media": flac.query,
    "op11_source_mixing": mixing.query,
    "op12_embedding_whitening": whitening.query,
    "op13_conversation_repair": repair.query,
}
ORACLES = {"op5_line_spread": lines.ORACLE_SQL, "op6_jaccard_components": nearjoin.ORACLE_SQL, "op7_stupid_backoff": backoff.ORACLE_SQL, "op11_source_mixing": mixing.ORACLE_SQL}
