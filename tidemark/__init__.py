"""Tidemark: Spark operators for dated snapshots of text-bearing records.

Every operator takes DataFrames plus column names and returns a DataFrame; nothing here
holds data of its own.  See ``README.md`` for the map of modules.
"""

import sys

from pyspark import cloudpickle

# the package's functions travel with the job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
