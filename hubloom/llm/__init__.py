"""Operators for preparing language-model training data, over documents and vectors."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions that run there travel with their modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
