"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import binary, decontaminate, embeddings, language, licenses, packing, pages, personal, quality, repair, shingles, toxicity, trie

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_ngram_jaccard": shingles.op2_ngram_jaccard,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_licenses": licenses.op5_licenses,
    "op6_html": pages.op6_html,
    "op7_language": language.op7_language,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_binary": binary.op10_binary,
    "op11_repair": repair.op11_repair,
    "op12_trie": trie.op12_trie,
    "op13_personal": personal.op13_personal,
}

ORACLES: dict[str, str] = {
    "op5_licenses": licenses.ORACLE,
    "op11_repair": repair.ORACLE,
    "op12_trie": trie.ORACLE,
    "op13_personal": personal.ORACLE,
}
