"""All queries of this subpackage; importing the modules registers them."""

from arbora.llm import (  # noqa: F401
    bpe, exact_dedup, html_text, jaccard_join, language_id, lexical_search, licenses, mixing, perplexity,
    personal_data, prefix_trie, simhash, unit_dedup)
from arbora.llm.common import ORACLES, QUERIES  # noqa: F401
