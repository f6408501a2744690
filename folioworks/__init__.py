"""Spark jobs over collections of packaged documents and over device readings.

Every public function takes and returns DataFrames (or Columns).  The modules:

``functions``  column expressions (names, sizes, reference targets, readings)
``sources``    packages on a file system, XML parts, status payloads, images
``operators``  DataFrame -> DataFrame steps: classify, reconcile, aggregate, lock
``plans``      whole jobs: first pass, second pass, publishing, report, telemetry
``streaming``  the same jobs fed by Structured Streaming
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so a cluster
# needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
