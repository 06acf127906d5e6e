"""Corpus tokenization, byte pair encoding, trace analytics and training-data operators on Spark."""

from pyspark import cloudpickle

import lexigrain as _self

# functions that run on the executors carry their code: a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(_self)
