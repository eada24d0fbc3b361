"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from tessella.llm.bpe import op1_bpe
from tessella.llm.chat import OP8_SQL, TOOL_CALLS_SQL, chat_tool_calls, op8_chat
from tessella.llm.decontam import OP5_SQL, op5_decontamination
from tessella.llm.htmltext import op9_html
from tessella.llm.jaccard import OP13_SQL, op13_jaccard
from tessella.llm.langid import op3_language
from tessella.llm.quality import op2_quality
from tessella.llm.repeats import op4_suffix_dedup
from tessella.llm.sharding import op7_sharding
from tessella.llm.simhash import op6_simhash
from tessella.llm.spelling import OP11_SQL, op11_spelling
from tessella.llm.tiff import op10_tiff
from tessella.llm.whitening import op12_whitening

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_html": op9_html,
    "op10_tiff": op10_tiff,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_jaccard": op13_jaccard,
    "chat_tool_calls": chat_tool_calls,
}
ORACLES: dict[str, str] = {"op5_decontamination": OP5_SQL, "op8_chat": OP8_SQL, "op11_spelling": OP11_SQL, "op13_jaccard": OP13_SQL, "chat_tool_calls": TOOL_CALLS_SQL}
