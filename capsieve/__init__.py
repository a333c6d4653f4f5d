"""Caption quality assurance on Spark: catalogs, transcripts, gates, runs and event logs as DataFrames."""

import sys

from pyspark import cloudpickle

# The Arrow UDFs travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
