"""The operators as registered queries."""

from serialis.llm import alignment, audio, hmm, html, language, lexicon, linedup, mixing, neardup, neighbours, pieces, quality, spelling

QUERIES = {
    "op1_audio_features": audio.op1_audio_features,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_scoring": hmm.op5_lm_scoring,
    "op6_quality": quality.op6_quality,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_language_id": language.op8_language_id,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_line_dedup": linedup.op10_line_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_word_bpe": lexicon.op12_word_bpe,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLE_SQL = {"op4_mixing": mixing.OP4_SQL, "op10_line_dedup": linedup.OP10_SQL, "op11_spelling_variants": spelling.OP11_SQL}
