"""Operators for the preparation of training text."""

import sys

from pyspark import cloudpickle

from sparrowmill.llm import collocations, decontamination, neighbours, ordinal, packing, pii, quality_rules, quotes, runs, secrets, sharding, simhash, toxicity

MODULES = (sharding, quality_rules, pii, decontamination, secrets, ordinal, toxicity, simhash, quotes, packing, collocations, neighbours, runs)
# Functions go to the executors with all they need: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
