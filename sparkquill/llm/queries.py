"""Queries over the driver's tables, one for each corpus operator, and SQL for those that SQL can express."""

from __future__ import annotations

from sparkquill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from sparkquill.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from sparkquill.llm.html_extract import op10_html_extract
from sparkquill.llm.importance import OP13_SQL, op13_importance
from sparkquill.llm.langid import op4_language_id
from sparkquill.llm.packing import op2_packing
from sparkquill.llm.quality import op8_quality
from sparkquill.llm.secret_scan import OP9_SQL, op9_secret_scan
from sparkquill.llm.sentencepiece_lattice import op7_sentencepiece
from sparkquill.llm.simhash import op6_simhash
from sparkquill.llm.token_counts import op5_token_counts
from sparkquill.llm.topk import OP3_SQL, op3_top_k
from sparkquill.llm.toxicity import op11_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_packing,
        op3_top_k,
        op4_language_id,
        op5_token_counts,
        op6_simhash,
        op7_sentencepiece,
        op8_quality,
        op9_secret_scan,
        op10_html_extract,
        op11_toxicity,
        op12_fill_in_middle,
        op13_importance,
    )
}
SQL = {"op1_exact_dedup": OP1_SQL, "op3_top_k": OP3_SQL, "op9_secret_scan": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_importance": OP13_SQL}
