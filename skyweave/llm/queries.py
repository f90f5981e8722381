"""The queries and SQL of this subpackage, which __spark_entry__.py adds."""

from __future__ import annotations

from .ann import op10_additive_quantisation
from .chat import OP12_SQL, op12_reply_trees
from .decontam import op4_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .langid import op8_language_id
from .ngram_lm import op9_ngram_lm
from .packing import op2_best_two_fit
from .repeats import op5_suffix_repeats
from .secret_scan import op7_secret_scan
from .shards import op6_minimax_shards
from .simhash import op3_simhash
from .spelling import op11_spelling_variants
from .token_store import op1_token_store

QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_best_two_fit, op3_simhash, op4_decontamination, op5_suffix_repeats, op6_minimax_shards, op7_secret_scan, op8_language_id, op9_ngram_lm, op10_additive_quantisation, op11_spelling_variants, op12_reply_trees, op13_source_divergence)
}
SQL: dict[str, str] = {"op12_reply_trees": OP12_SQL, "op13_source_divergence": OP13_SQL}
