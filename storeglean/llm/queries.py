"""The queries of the operators, each with the SQL statement that checks it or None."""

from storeglean.llm import anomaly, decontamination, hardneg, langid, linededup, neardup, ordinal
from storeglean.llm import packing, sharding, toxicity, vptree, warc, whitening

_MODULES = (sharding, linededup, ordinal, packing, anomaly, langid, decontamination, neardup, toxicity, warc, hardneg, whitening, vptree)
QUERIES = {name: pair for module in _MODULES for name, pair in module.QUERIES.items()}
