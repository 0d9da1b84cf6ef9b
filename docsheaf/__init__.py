"""docsheaf: document-processing analytics on Spark DataFrames.

Functions of this package that run inside Python workers are pickled by value,
so executors need pyspark and the public libraries but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
