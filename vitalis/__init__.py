"""vitalis — tabular risk analytics on Spark DataFrames.

Operators are plain functions ``DataFrame -> DataFrame`` grouped by stage:

* ``vitalis.sources``   — table sources/sinks, previews, model package store
* ``vitalis.operators`` — cleaning, missing data, exploration, split/rebalance,
  models, evaluation, registry, scoring, explanation
* ``vitalis.functions`` — Column-level helpers (hash RNG, exact ranks/quantiles,
  statistics)
* ``vitalis.plans``     — the registered queries, their SQL and the TESTDATA fixtures
* ``vitalis.streaming`` — the scoring plan attached to a file stream
"""

import sys

from pyspark import cloudpickle

from vitalis.session import checkpoint_dir, get_spark

# Python code that runs inside tasks (the pandas UDF of functions/stats.py) is
# shipped with the task itself, so executors need no installed copy of the
# package and no --py-files entry.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
