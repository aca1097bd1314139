"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .flac import op6_flac
from .jaccard import op9_token_group_matrix
from .licenses import op8_rare_token_index
from .mixing import op3_pivotal_mix
from .oracles import OP2, OP9, OP12, OP13
from .packing import op10_martello_toth
from .pieces import op11_offset_pieces
from .quality import op4_mcd_outliers
from .resampling import op12_word_dictionary
from .runs import op13_kolpakov_kucherov
from .sharding import op7_hash_tree
from .substrings import op2_debruijn
from .token_counts import op1_trie_tokens
from .toxicity import op5_cumulative_link

QUERIES = {
    "op1_trie_tokens": op1_trie_tokens,
    "op2_debruijn": op2_debruijn,
    "op3_pivotal_mix": op3_pivotal_mix,
    "op4_mcd_outliers": op4_mcd_outliers,
    "op5_cumulative_link": op5_cumulative_link,
    "op6_flac": op6_flac,
    "op7_hash_tree": op7_hash_tree,
    "op8_rare_token_index": op8_rare_token_index,
    "op9_token_group_matrix": op9_token_group_matrix,
    "op10_martello_toth": op10_martello_toth,
    "op11_offset_pieces": op11_offset_pieces,
    "op12_word_dictionary": op12_word_dictionary,
    "op13_kolpakov_kucherov": op13_kolpakov_kucherov,
}

#: The others draw by a hash that DuckDB lacks, fit a model, or run a tokenizer or a codec; tests/llm has their plain versions.
ORACLES: dict[str, str] = {"op2_debruijn": OP2, "op9_token_group_matrix": OP9, "op12_word_dictionary": OP12, "op13_kolpakov_kucherov": OP13}
