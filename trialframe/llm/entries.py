"""Queries and DuckDB SQL of the operators, for ``__spark_entry__``."""

from __future__ import annotations

from functools import wraps

from trialframe.llm.common import ship
from trialframe.llm.op1_sentencepiece import op1_sentencepiece
from trialframe.llm.op2_pii import op2_pii
from trialframe.llm.op3_jaccard import op3_jaccard
from trialframe.llm.op4_decontaminate import op4_decontaminate
from trialframe.llm.op5_url_filter import op5_sql, op5_url_filter
from trialframe.llm.op6_html_text import op6_html_text
from trialframe.llm.op7_pseudo_likelihood import op7_pseudo_likelihood
from trialframe.llm.op8_ann import op8_ann
from trialframe.llm.op9_language import op9_language
from trialframe.llm.op10_secrets import op10_secrets
from trialframe.llm.op11_suffix_dedup import op11_sql, op11_suffix_dedup
from trialframe.llm.op12_manifest import op12_manifest, op12_sql
from trialframe.llm.op13_filter_audit import op13_filter_audit, op13_sql


def shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: shipped(f) for f in (
    op1_sentencepiece, op2_pii, op3_jaccard, op4_decontaminate, op5_url_filter, op6_html_text, op7_pseudo_likelihood,
    op8_ann, op9_language, op10_secrets, op11_suffix_dedup, op12_manifest, op13_filter_audit)}
ORACLES = {"op5_url_filter": op5_sql(), "op11_suffix_dedup": op11_sql(), "op12_manifest": op12_sql(), "op13_filter_audit": op13_sql()}
