"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op9_ann
from .bpe import op10_bpe
from .chat import OP3_SQL, op3_chat
from .collocations import OP11_SQL, op11_collocations
from .divergence import OP13_SQL, op13_divergence
from .kdtree import OP2_SQL, op2_kdtree
from .line_dedup import OP12_SQL, op12_line_dedup
from .mixing import OP1_SQL, op1_mixing
from .ngram_join import OP6_SQL, op6_ngram_join
from .pii import op8_pii
from .quality import op5_quality
from .secrets import op4_secrets
from .url_filter import OP7_SQL, op7_url_filter

REGISTRY = {f.__name__: f for f in (op1_mixing, op2_kdtree, op3_chat, op4_secrets, op5_quality, op6_ngram_join, op7_url_filter, op8_pii, op9_ann, op10_bpe, op11_collocations, op12_line_dedup, op13_divergence)}
ORACLES = {"op1_mixing": OP1_SQL, "op2_kdtree": OP2_SQL, "op3_chat": OP3_SQL, "op6_ngram_join": OP6_SQL, "op7_url_filter": OP7_SQL, "op11_collocations": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_divergence": OP13_SQL}
