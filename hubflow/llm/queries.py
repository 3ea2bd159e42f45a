"""The queries of this folder and their SQL, for __spark_entry__.py."""

from hubflow.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from hubflow.llm.huffman import op7_huffman_token_files
from hubflow.llm.lexical_search import OP11_SQL, op11_reversed_search
from hubflow.llm.matroska import op2_matroska
from hubflow.llm.mixing import op8_mixing
from hubflow.llm.near_dedup import OP4_SQL, op4_dart_minhash
from hubflow.llm.packing import op5_packing
from hubflow.llm.pitman_yor import op6_pitman_yor
from hubflow.llm.quality import op10_quality
from hubflow.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from hubflow.llm.token_counts import op3_sql, op3_token_counts
from hubflow.llm.top_k import OP9_SQL, op9_kd_tree_top_k
from hubflow.llm.warc import OP12_SQL, op12_warc

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_matroska, op3_token_counts, op4_dart_minhash, op5_packing, op6_pitman_yor, op7_huffman_token_files, op8_mixing, op9_kd_tree_top_k, op10_quality, op11_reversed_search, op12_warc, op13_fill_in_middle)}

SQL = {"op1_substring_dedup": OP1_SQL, "op3_token_counts": op3_sql(), "op4_dart_minhash": OP4_SQL, "op9_kd_tree_top_k": OP9_SQL, "op11_reversed_search": OP11_SQL, "op12_warc": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
