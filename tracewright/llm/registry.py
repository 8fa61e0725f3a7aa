"""Queries of the numbered operators, and their SQL where SQL can express them."""

from tracewright.llm.alignment import op13_pair_alignment
from tracewright.llm.bpe import op10_bpe_trie
from tracewright.llm.fingerprints import op7_scaled_sketches
from tracewright.llm import licenses, minhash, mixing, topk
from tracewright.llm.language import op6_language
from tracewright.llm.licenses import op8_license_dice
from tracewright.llm.minhash import op3_minmax_dedup
from tracewright.llm.mixing import op9_mix_sources
from tracewright.llm.passages import op2_repeated_passages
from tracewright.llm.pieces import op11_piece_chunks
from tracewright.llm.sharding import op4_minimax_shards
from tracewright.llm.topk import op5_nra_topk
from tracewright.llm.toxicity import op1_toxicity
from tracewright.llm import wand
from tracewright.llm.wand import op12_block_max_search

def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op5_nra_topk": op5_nra_topk,
    "op10_bpe_trie": op10_bpe_trie,
    "op6_language": op6_language,
    "op1_toxicity": op1_toxicity,
    "op8_license_dice": op8_license_dice,
    "op7_scaled_sketches": op7_scaled_sketches,
    "op4_minimax_shards": op4_minimax_shards,
    "op9_mix_sources": op9_mix_sources,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op11_piece_chunks": op11_piece_chunks,
    "op12_block_max_search": op12_block_max_search,
    "op13_pair_alignment": op13_pair_alignment,
}
ORACLE_SQL = {"op9_mix_sources": mixing.ORACLE_SQL, "op3_minmax_dedup": minhash.ORACLE_SQL, "op12_block_max_search": wand.ORACLE_SQL, "op5_nra_topk": topk.ORACLE_SQL, "op8_license_dice": licenses.ORACLE_SQL}
