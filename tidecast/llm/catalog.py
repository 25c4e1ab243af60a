"""One registered query per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidecast.llm import (
    collocations, decontaminate, exact_dedup, language_id, mixing, quality, secrets, simhash, spelling, substrings, toxicity, url_filter, warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_language_id": language_id.query,
    "op4_simhash_golay": simhash.query,
    "op5_source_mix": mixing.query,
    "op6_secret_scan": secrets.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": url_filter.query,
    "op9_warc_revisits": warc.query,
    "op10_quality": quality.query,
    "op11_collocations": collocations.query,
    "op12_substring_dedup": substrings.query,
    "op13_spelling_variants": spelling.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op5_source_mix": mixing.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_warc_revisits": warc.SQL,
    "op11_collocations": collocations.SQL,
    "op12_substring_dedup": substrings.SQL,
    "op13_spelling_variants": spelling.SQL,
}
