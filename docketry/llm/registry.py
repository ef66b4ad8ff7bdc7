"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.bpe import op2_bpe
from docketry.llm.langid import op10_langid
from docketry.llm.licences import op4_licences
from docketry.llm.linededup import OP3_SQL, op3_linededup
from docketry.llm.lm import op5_lm
from docketry.llm.mixing import op1_mix
from docketry.llm.neardup import OP6_SQL, op6_neardup
from docketry.llm.packing import op12_packing
from docketry.llm.phrases import OP11_SQL, op11_phrases
from docketry.llm.quality import op7_quality
from docketry.llm.repeats import op13_repeats
from docketry.llm.vectors import OP9_SQL, op9_vectors
from docketry.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_bpe, op3_linededup, op4_licences, op5_lm, op6_neardup, op7_quality, op8_warc, op9_vectors, op10_langid, op11_phrases, op12_packing, op13_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op3_linededup": OP3_SQL, "op6_neardup": OP6_SQL, "op8_warc": OP8_SQL, "op9_vectors": OP9_SQL, "op11_phrases": OP11_SQL}
