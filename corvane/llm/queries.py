"""The queries of this subpackage and the SQL of those that SQL can express."""

from corvane.llm.decontaminate import OP10_SQL, op10_wu_manber_decontamination
from corvane.llm.fingerprints import op1_lz_fingerprint
from corvane.llm.html_text import op9_html_main_text
from corvane.llm.language import op7_language_id
from corvane.llm.mixing import OP3_SQL, op3_systematic_mix
from corvane.llm.near_dedup import OP2_SQL, op2_min_max_near_dedup
from corvane.llm.quality import op6_quality_gam
from corvane.llm.resampling import OP11_SQL, op11_importance_resampling
from corvane.llm.sharding import op5_size_tiered_shards
from corvane.llm.simhash import op12_bk_simhash
from corvane.llm.token_counts import op8_token_counts
from corvane.llm.token_files import op4_huffman_token_files
from corvane.llm.vector_codes import OP13_SQL, op13_heap_lloyd_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_lz_fingerprint, op2_min_max_near_dedup, op3_systematic_mix, op4_huffman_token_files, op5_size_tiered_shards,
        op6_quality_gam, op7_language_id, op8_token_counts, op9_html_main_text, op10_wu_manber_decontamination,
        op11_importance_resampling, op12_bk_simhash, op13_heap_lloyd_codes,
    )
}
ORACLE_SQL = {"op2_min_max_near_dedup": OP2_SQL, "op3_systematic_mix": OP3_SQL, "op10_wu_manber_decontamination": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_heap_lloyd_codes": OP13_SQL}
