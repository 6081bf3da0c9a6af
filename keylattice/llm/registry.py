"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from keylattice.llm import bpe, conversation_repair, html_text, jaccard_join, lexical_search, media, mixing, quality, sharding, token_store, toxicity, url_filter, vector_search

QUERIES = {
    f.__name__: f
    for f in (
        vector_search.op1_vector_search,
        quality.op2_quality,
        media.op3_media,
        token_store.op4_token_store,
        toxicity.op5_toxicity,
        html_text.op6_html_text,
        url_filter.op7_url_filter,
        bpe.op8_byte_bpe,
        jaccard_join.op9_jaccard_join,
        mixing.op10_mixing,
        conversation_repair.op11_conversation_repair,
        sharding.op12_kd_sharding,
        lexical_search.op13_lexical_search,
    )
}
ORACLE_SQL = vector_search.ORACLE | url_filter.ORACLE | conversation_repair.ORACLE | lexical_search.ORACLE
