"""An article-feed analytics engine on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel with a job by value, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
