"""All queries of this subpackage, by name, and their SQL."""

from corpusforge.llm import (  # noqa: F401
    conversation_trie,
    decontamination,
    filter_audit,
    fixity,
    jaccard_join,
    line_chunks,
    minmax_dedup,
    packing,
    perplexity,
    pii,
    shards,
    substrings,
    url_lists,
)
from corpusforge.llm.common import QUERIES, SQL  # noqa: F401
