"""Operators for preparing training data.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so executors need this package's dependencies but not
the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
