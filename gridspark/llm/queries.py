"""The queries of this subpackage and the SQL of those that SQL can express."""

from gridspark.llm import (
    chat,
    digests,
    jaccard,
    language,
    lexical,
    mixing,
    neighbours,
    packing,
    perplexity,
    quality,
    suffixes,
    trie,
    urls,
)

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_language_id": language.op2_language_id,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality_classifier": perplexity.op7_quality_classifier,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filters": urls.op9_url_filters,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_exact_dedup": digests.op11_exact_dedup,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLE = {
    "op5_mixing": mixing.SQL,
    "op6_chat_formatting": chat.SQL,
    "op9_url_filters": urls.SQL,
    "op11_exact_dedup": digests.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_lexical_search": lexical.SQL,
}
