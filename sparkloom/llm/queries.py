"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import heapkmeans, perspectives, prefixtrie
from sparkloom.llm.bpe import op9_bpe
from sparkloom.llm.editcount import op2_edit_counts
from sparkloom.llm.hostrepeats import op8_host_repeats
from sparkloom.llm.minhash import op6_minhash
from sparkloom.llm.repair import op4_repair
from sparkloom.llm.repeats import op5_repeats
from sparkloom.llm.spotsigs import op7_spotsigs
from sparkloom.llm.secrets import op12_zstd_novelty
from sparkloom.llm.toxicity import op1_bigru
from sparkloom.llm.winnowing import op10_winnowing

QUERIES = {
    "op1_bigru": op1_bigru,
    "op2_edit_counts": op2_edit_counts,
    "op3_perspectives": perspectives.op3_perspectives,
    "op4_repair": op4_repair,
    "op5_repeats": op5_repeats,
    "op6_minhash": op6_minhash,
    "op7_spotsigs": op7_spotsigs,
    "op8_host_repeats": op8_host_repeats,
    "op9_bpe": op9_bpe,
    "op10_winnowing": op10_winnowing,
    "op11_heap_kmeans": heapkmeans.op11_heap_kmeans,
    "op12_zstd_novelty": op12_zstd_novelty,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_perspectives": perspectives.SQL, "op11_heap_kmeans": heapkmeans.sql(), "op13_prefix_trie": prefixtrie.SQL}
