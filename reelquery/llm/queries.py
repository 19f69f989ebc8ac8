"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from reelquery.llm.digests import op6_digests
from reelquery.llm.languages import op2_language_mixtures
from reelquery.llm.licenses import OP5_SQL, op5_license_scan
from reelquery.llm.line_dedup import OP7_SQL, op7_line_dedup
from reelquery.llm.mixing import OP10_SQL, op10_mix_sources
from reelquery.llm.ngram_join import OP9_SQL, op9_ngram_join
from reelquery.llm.nn_descent import op4_near_duplicates
from reelquery.llm.pieces import op8_sentencepiece
from reelquery.llm.secrets import OP1_SQL, op1_secret_scan
from reelquery.llm.sharding import op3_shards

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_mixtures": op2_language_mixtures,
    "op3_shards": op3_shards,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_license_scan": op5_license_scan,
    "op6_digests": op6_digests,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_join": op9_ngram_join,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES = {
    "op1_secret_scan": OP1_SQL,
    "op5_license_scan": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_ngram_join": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
}
