"""Operators for the preparation of training text. Nothing else in the library imports them."""

from pyspark import cloudpickle

import plumbgrid

# From a checkout, tasks can not import the package; its functions travel with the job.
cloudpickle.register_pickle_by_value(plumbgrid)
