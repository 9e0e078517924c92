"""Operators for preparing training text, one module per operator; queries in `queries`.

Python code that runs in tasks is sent along by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
