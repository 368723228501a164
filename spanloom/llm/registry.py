"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.op1 import op1_language_id
from spanloom.llm.op2 import op2_suffix_dedup
from spanloom.llm.op3 import op3_secret_scan
from spanloom.llm.op4 import OP4_SQL, op4_warc
from spanloom.llm.op5 import OP5_SQL, op5_substring_dedup
from spanloom.llm.op6 import op6_mixing
from spanloom.llm.op7 import OP7_SQL, op7_ngram_join
from spanloom.llm.op8 import op8_quality_rules
from spanloom.llm.op9 import OP9_SQL, op9_url_filter
from spanloom.llm.op10 import OP10_SQL, op10_decontaminate
from spanloom.llm.op11 import OP11_SQL, op11_fill_in_middle
from spanloom.llm.op12 import OP12_SQL, op12_prefix_trie
from spanloom.llm.op13 import op13_learned_partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_suffix_dedup,
        op3_secret_scan,
        op4_warc,
        op5_substring_dedup,
        op6_mixing,
        op7_ngram_join,
        op8_quality_rules,
        op9_url_filter,
        op10_decontaminate,
        op11_fill_in_middle,
        op12_prefix_trie,
        op13_learned_partitions,
    )
}
SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_ngram_join": OP7_SQL, "op9_url_filter": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_prefix_trie": OP12_SQL}
