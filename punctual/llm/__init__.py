"""Operators of a training-data pipeline; nothing else in the library imports them."""

from pyspark import cloudpickle

import punctual

# Python workers may start in another folder: ship the package's functions with the tasks
cloudpickle.register_pickle_by_value(punctual)
