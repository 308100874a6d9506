"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quillspan.llm import chat, contamination, language, neardup, pages, pieces, privacy, quality, substrings, warc

QUERIES = {
    "op1_jaccard": neardup.op1_jaccard,
    "op2_substrings": substrings.op2_substrings,
    "op3_pages": pages.op3_pages,
    "op4_warc": warc.op4_warc,
    "op5_privacy": privacy.op5_privacy,
    "op6_contamination": contamination.op6_contamination,
    "op7_language": language.op7_language,
    "op8_chat": chat.op8_chat,
    "op9_pieces": pieces.op9_pieces,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL = {
    "op2_substrings": substrings.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_contamination": contamination.OP6_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_quality": quality.OP10_SQL,
}
