"""Operators for training-data pipelines. Nothing outside this subpackage and corpus_pipeline.py imports it."""

from pyspark import cloudpickle

import sievemark

# Executors that don't have this package on their path get its functions by value.
cloudpickle.register_pickle_by_value(sievemark)
