"""tessera: evidence fusion, entity resolution and corpus operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
