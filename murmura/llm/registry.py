"""The queries of this subpackage, and SQL where it can say the same."""

from murmura.llm.chat import OP3_SQL, op3_chat_format
from murmura.llm.decontaminate import op9_decontamination
from murmura.llm.html_text import op4_html_text
from murmura.llm.infill import OP11_SQL, op11_fill_in_middle
from murmura.llm.licenses import op5_license_scan
from murmura.llm.mixing import OP12_SQL, op12_mixing
from murmura.llm.near_dedup import OP1_SQL, op1_near_dedup
from murmura.llm.passages import op8_suffix_dedup
from murmura.llm.phrases import OP13_SQL, op13_phrases
from murmura.llm.pieces import op2_sentencepiece
from murmura.llm.quality import op6_quality_rules
from murmura.llm.shards import op10_sharding
from murmura.llm.urls import OP7_SQL, op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_sentencepiece,
        op3_chat_format,
        op4_html_text,
        op5_license_scan,
        op6_quality_rules,
        op7_url_filter,
        op8_suffix_dedup,
        op9_decontamination,
        op10_sharding,
        op11_fill_in_middle,
        op12_mixing,
        op13_phrases,
    )
}
SQL = {"op1_near_dedup": OP1_SQL, "op3_chat_format": OP3_SQL, "op7_url_filter": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_mixing": OP12_SQL, "op13_phrases": OP13_SQL}
