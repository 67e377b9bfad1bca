"""fairline: market-quote analytics as Spark DataFrame jobs.

Layers
------
functions   column expressions (prices, lines, settlement, bands, names, times, statistics)
operators   DataFrame -> DataFrame building blocks (grouping, as-of, movement, identity, ...)
sources     readers, sinks, feed normalisers, derived views
plans       composed reports (audits, screening, forward evaluation, data quality)
streaming   Structured Streaming forms of the time-driven operators
queries     the registered queries and their SQL counterparts
"""

import sys

from pyspark import cloudpickle

# Python workers receive the few Arrow functions by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
