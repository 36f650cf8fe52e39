"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .language import op7_language
from .lines import op4_lines
from .media import op1_media
from .minhash import op8_minhash
from .mixing import op10_mixing
from .passages import op2_passages
from .quality import OP3_SQL, op3_quality
from .substrings import op6_substrings
from .token_counts import op9_token_counts

QUERIES = {"op1_media": op1_media, "op2_passages": op2_passages, "op3_quality": op3_quality, "op4_lines": op4_lines, "op5_bpe": op5_bpe, "op6_substrings": op6_substrings, "op7_language": op7_language, "op8_minhash": op8_minhash, "op9_token_counts": op9_token_counts, "op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {"op3_quality": OP3_SQL}
