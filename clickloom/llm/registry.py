"""The numbered operators as queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm.decontaminate import OP9_SQL, op9_benchmark_leaks
from clickloom.llm.html_model import op2_tree_model
from clickloom.llm.language import op3_segmentation_unigrams
from clickloom.llm.licenses import op7_license_windows
from clickloom.llm.neighbours import op12_nn_descent
from clickloom.llm.packing import op8_vector_packing
from clickloom.llm.pii import op10_surrogates
from clickloom.llm.repair import op11_branch_and_bound
from clickloom.llm.secrets import op5_markov_secrets
from clickloom.llm.simhash import op6_simhash
from clickloom.llm.topk import OP4_SQL, op4_term_at_a_time
from clickloom.llm.warc import OP1_SQL, op1_revisits
from clickloom.llm.whitening import op13_block_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_revisits,
        op2_tree_model,
        op3_segmentation_unigrams,
        op4_term_at_a_time,
        op5_markov_secrets,
        op6_simhash,
        op7_license_windows,
        op8_vector_packing,
        op9_benchmark_leaks,
        op10_surrogates,
        op11_branch_and_bound,
        op12_nn_descent,
        op13_block_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_revisits": OP1_SQL,
    "op4_term_at_a_time": OP4_SQL,
    "op9_benchmark_leaks": OP9_SQL,
}
