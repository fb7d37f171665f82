"""Spark-native analytics over logs of tool-using agent runs."""

import sys

from pyspark import cloudpickle

# Executors needn't have the package: functions of it travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
