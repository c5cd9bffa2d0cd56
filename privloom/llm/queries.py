"""The queries of this subpackage and their SQL, where SQL can express one."""

from privloom.llm.ann_op import op1_ann
from privloom.llm.encode_op import op7_byte_bpe
from privloom.llm.lang_op import op6_language_id
from privloom.llm.license_op import OP13_SQL, op13_license_scan
from privloom.llm.line_op import op8_line_dedup
from privloom.llm.omh_op import op2_order_minhash
from privloom.llm.pack_op import op4_packing
from privloom.llm.quality_op import op10_quality
from privloom.llm.repair_op import OP12_SQL, op12_conversation_repair
from privloom.llm.search_op import OP11_SQL, op11_lexical_search
from privloom.llm.simhash_op import op9_simhash
from privloom.llm.toxic_op import op5_toxicity
from privloom.llm.url_op import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_ann": op1_ann,
    "op2_order_minhash": op2_order_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op11_lexical_search": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_license_scan": OP13_SQL}
