"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import covertree, filteraudit, mixing, secrets, urlrules, warc
from .covertree import op4_cover_tree_topk
from .filteraudit import op12_filter_audit
from .htmltext import op3_html_suffix_array
from .kneserney import op9_quality_classifier
from .mixing import op7_source_mixing
from .outliers import op1_quality_outliers
from .packing import op8_packing
from .repair import op11_conversation_repair
from .secrets import op13_secret_links
from .simhash import op6_simhash_neardup
from .toxicity import op5_toxicity
from .urlrules import op2_url_filter
from .warc import op10_warc

QUERIES = {
    "op1_quality_outliers": op1_quality_outliers,
    "op2_url_filter": op2_url_filter,
    "op7_source_mixing": op7_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op8_packing": op8_packing,
    "op10_warc": op10_warc,
    "op4_cover_tree_topk": op4_cover_tree_topk,
    "op3_html_suffix_array": op3_html_suffix_array,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_secret_links": op13_secret_links,
}
ORACLES: dict[str, str] = {
    "op4_cover_tree_topk": covertree.ORACLE,
    "op10_warc": warc.ORACLE,
    "op2_url_filter": urlrules.oracle(),
    "op7_source_mixing": mixing.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
    "op13_secret_links": secrets.oracle(),
}
