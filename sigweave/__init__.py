"""sigweave: table operators for signature-consistency analytics on PySpark.

Every operator takes DataFrames and returns a DataFrame. Operators are lazy, except
where ``operators.common.reuse`` checkpoints a narrow table read by several branches.
Key column names are parameters, ``by`` is always a list of grouping columns.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels travel with the task, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
