"""The operators of this subpackage as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from tidemill.llm.best_fit import op6_best_fit
from tidemill.llm.block_names import OP1_SQL, op1_block_naming
from tidemill.llm.byte_bpe import op4_byte_bpe
from tidemill.llm.fill_middle import OP13_SQL, op13_fill_middle
from tidemill.llm.hamming_index import op7_hamming_index
from tidemill.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tidemill.llm.hilbert_shards import op2_hilbert_shards
from tidemill.llm.line_dedup import OP10_SQL, op10_line_dedup
from tidemill.llm.near_dups import op8_near_dups
from tidemill.llm.secret_ledger import op9_secret_ledger
from tidemill.llm.source_mix import op11_source_mix
from tidemill.llm.warc_derive import op3_warc_derive
from tidemill.llm.weak_labels import op5_weak_labels

QUERIES = {
    "op1_block_naming": (op1_block_naming, OP1_SQL),
    "op2_hilbert_shards": (op2_hilbert_shards, None),
    "op3_warc_derive": (op3_warc_derive, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_weak_labels": (op5_weak_labels, None),
    "op6_best_fit": (op6_best_fit, None),
    "op7_hamming_index": (op7_hamming_index, None),
    "op8_near_dups": (op8_near_dups, None),
    "op9_secret_ledger": (op9_secret_ledger, None),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_source_mix": (op11_source_mix, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_fill_middle": (op13_fill_middle, OP13_SQL),
}
