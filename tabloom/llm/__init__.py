"""Operators of a large-scale training-data pipeline.

Each module holds one operator and its registered query. Functions of this
package that run in Python workers are pickled by value, so a cluster needs no
copy of the package on its executors.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_all() -> dict[str, tuple]:
    """Registered queries: name -> (builder, oracle SQL or None)."""
    from tabloom.llm import ann, divergence, jaccard, line_dedup, line_rules, mixing, packing, quality_lm, simhash, suffix_dedup, token_orc, warc, whitening  # noqa: F401
    from tabloom.llm.common import REGISTRY
    return REGISTRY
