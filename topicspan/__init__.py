"""Topic analysis of short texts as Spark DataFrame operators.

``sources``    read and write corpora, label tables and model bundles
``functions``  column expressions (tokens, n-grams, argmax, ratios)
``operators``  DataFrame -> DataFrame steps
``plans``      the three end-to-end flows and the query registry
``streaming``  scoring jobs on arriving texts
"""

from topicspan.session import local_session

__all__ = ["local_session"]
__version__ = "0.1.0"
