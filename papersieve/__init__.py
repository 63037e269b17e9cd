"""Spark-native triage of document threats.

Every public function takes DataFrames and returns DataFrames; nothing here runs
an action except where a docstring says so (durable checkpoints, the bounded
name-tree loop, and sinks).
"""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks with the job itself, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
