"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its functions are pickled by value,
so executors need numpy, pyarrow and the libraries an operator names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
