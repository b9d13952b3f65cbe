"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from quayline.llm import decontaminate
from quayline.llm.alignment import op12_alignment
from quayline.llm.bpe import op1_bpe
from quayline.llm.decontaminate import op6_decontaminate
from quayline.llm.jaccard import op7_jaccard
from quayline.llm.languages import op10_languages
from quayline.llm.middle import op13_middle
from quayline.llm.minhash import op11_minhash
from quayline.llm.pitman_yor import op2_lm
from quayline.llm.quality_model import op4_quality
from quayline.llm.quality_rules import op5_quality_rules
from quayline.llm.secrets import op9_secrets
from quayline.llm.token_files import op3_token_files
from quayline.llm.urls import op8_urls

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_jaccard": op7_jaccard,
    "op8_urls": op8_urls,
    "op9_secrets": op9_secrets,
    "op10_languages": op10_languages,
    "op11_minhash": op11_minhash,
    "op12_alignment": op12_alignment,
    "op13_middle": op13_middle,
}
ORACLES = {
    "op6_decontaminate": decontaminate.ORACLE,
}
