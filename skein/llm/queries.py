"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from skein.llm.chat import OP4_SQL, op4_chat
from skein.llm.decontaminate import OP3_SQL, op3_decontaminate
from skein.llm.fim import OP12_SQL, op12_fim
from skein.llm.langid import op6_langid
from skein.llm.mixing import op8_mixing
from skein.llm.neardup import OP2_SQL, op2_neardup
from skein.llm.pages import op5_pages
from skein.llm.phrases import OP11_SQL, op11_phrases
from skein.llm.quality import op10_quality
from skein.llm.secrets import op7_secrets
from skein.llm.substrings import OP9_SQL, op9_substrings
from skein.llm.toxicity import op1_toxicity
from skein.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_neardup": op2_neardup,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_pages": op5_pages,
    "op6_langid": op6_langid,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_fim": op12_fim,
    "op13_warc": op13_warc,
}

ORACLE: dict[str, str] = {
    "op2_neardup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_chat": OP4_SQL,
    "op9_substrings": OP9_SQL,
    "op11_phrases": OP11_SQL,
    "op12_fim": OP12_SQL,
    "op13_warc": OP13_SQL,
}
