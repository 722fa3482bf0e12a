"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .align import op13_tokenizer_alignment
from .bpe import op7_byte_bpe
from .jaccard import OP9_SQL, op9_jaccard_join
from .langid import op8_language_mixture
from .licenses import OP6_SQL, op6_licence_sentences
from .mixing import OP2_SQL, op2_source_mix
from .pii import op12_weak_pii
from .secrets import op10_secret_battery
from .sharding import op5_uniform_shards
from .syncmers import op4_closed_syncmers
from .topk import OP1_SQL, op1_exact_top_products
from .toxicity import op3_toxicity
from .variants import op11_spelling_variants

QUERIES = {
    "op1_exact_top_products": op1_exact_top_products,
    "op2_source_mix": op2_source_mix,
    "op3_toxicity": op3_toxicity,
    "op4_closed_syncmers": op4_closed_syncmers,
    "op5_uniform_shards": op5_uniform_shards,
    "op6_licence_sentences": op6_licence_sentences,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_mixture": op8_language_mixture,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_battery": op10_secret_battery,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_weak_pii": op12_weak_pii,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL = {
    "op1_exact_top_products": OP1_SQL,
    "op2_source_mix": OP2_SQL,
    "op6_licence_sentences": OP6_SQL,
    "op9_jaccard_join": OP9_SQL,
}
