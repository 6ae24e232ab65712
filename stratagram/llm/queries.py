"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from .chat import OP10_SQL, op10_schema_fingerprint
from .decontaminate import OP7_SQL, op7_aho_corasick
from .digest import op9_quartile_digest
from .langid import op2_word_backoff
from .packing import op4_best_fit
from .quality import op1_random_indexing
from .secrets import op5_zstd_novelty
from .simhash import op6_simhash
from .tokenfile import op3_token_orc
from .warc import OP8_SQL, op8_gzip_normaliser

QUERIES = {f.__name__: f for f in (op1_random_indexing, op2_word_backoff, op3_token_orc, op4_best_fit, op5_zstd_novelty, op6_simhash, op7_aho_corasick, op8_gzip_normaliser, op9_quartile_digest, op10_schema_fingerprint)}
ORACLES = {"op7_aho_corasick": OP7_SQL, "op8_gzip_normaliser": OP8_SQL, "op10_schema_fingerprint": OP10_SQL}
