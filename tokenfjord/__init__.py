"""tokenfjord: text segmentation and token analytics on PySpark DataFrames.

Names for one text are here; ``tokenfjord.operators.frames`` has the same for
DataFrames, ``tokenfjord.functions.text`` column expressions, and
``tokenfjord.sql`` table functions.
"""

from .constants import EM_DASH, EN_DASH, TP_CENTER, TP_LEFT, TP_NONE, TP_RIGHT, TP_WORD
from .operators.abbreviations import Abbreviations, ConfigError, Meaning
from .operators.build import TokenStream, make
from .operators.engine import calculate_indexes, normalized_text_from_tokens, paragraphs, parse_tokens, split_into_sentences, text_from_tokens, tokenize, tokenize_without_annotation
from .operators.engine import shown as token_text
from .operators.segment import mark_paragraphs
from .operators.segment import raw_tokens as generate_raw_tokens
from .operators.spacing import correct_spaces, detokenize
from .operators.tokens import Kind, Token

__version__ = "0.1.0"


def normalized_text(token: Token) -> str:
    """A token's text, or its normal form if it is punctuation."""
    return token_text(token, normalize=True)


__all__ = [
    "EM_DASH", "EN_DASH", "TP_CENTER", "TP_LEFT", "TP_NONE", "TP_RIGHT", "TP_WORD", "Abbreviations", "ConfigError", "Kind", "Meaning", "Token", "TokenStream", "calculate_indexes", "correct_spaces", "detokenize", "generate_raw_tokens", "make", "mark_paragraphs", "normalized_text",
    "normalized_text_from_tokens", "paragraphs", "parse_tokens", "split_into_sentences", "text_from_tokens", "token_text", "tokenize", "tokenize_without_annotation",
]
