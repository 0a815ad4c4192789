from topicspan.functions.scalar import (
    first_max_position,
    log2_ratio,
    page_of,
    parse_page,
    softmax,
    strip_prefix,
    topic_caption,
)
from topicspan.functions.text import WORD_PATTERN, starts_with_term, word_array, word_runs

__all__ = [
    "WORD_PATTERN",
    "first_max_position",
    "log2_ratio",
    "page_of",
    "parse_page",
    "softmax",
    "starts_with_term",
    "strip_prefix",
    "topic_caption",
    "word_array",
    "word_runs",
]
