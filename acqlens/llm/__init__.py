"""Training-data operators: formatting, filtering, near-duplicates, scoring and packing.

Nothing else in the package imports this subpackage. ``queries.py`` holds the
registered queries and ``corpus_pipeline.py`` at the repository top chains five
of the operators.

Functions that run in Spark's Python workers travel by value, so executors need
numpy and pyarrow but no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
