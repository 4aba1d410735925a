"""snipflow: code-corpus analytics on Spark.

Snippets become a table of syntax nodes, structural features are relational
queries over that table, complexity is a rule cascade, the classifier is
Spark ML, and execution traces are step-record tables or streams.
"""

from snipflow.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that a
# cluster needs no copy of the package on its hosts.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
