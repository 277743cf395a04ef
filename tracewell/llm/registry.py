"""Queries of this subpackage, by name; SQL where SQL can express one."""

from .ann import op7_ann
from .bpe_coding import op2_bpe_coding
from .chat import OP12_SQL, op12_chat_formatting
from .divergence import OP13_SQL, op13_divergence
from .lexical import OP11_SQL, op11_lexical_search
from .ngram_join import op3_ngram_join
from .packing import op6_packing
from .pii import op5_pii
from .quality_rules import op10_quality_rules
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op8_token_counts
from .toxicity import op9_toxicity
from .url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_bpe_coding": op2_bpe_coding,
    "op3_ngram_join": op3_ngram_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_ann": op7_ann,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_divergence": op13_divergence,
}

SQL = {"op1_url_filters": OP1_SQL, "op11_lexical_search": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_divergence": OP13_SQL}
