"""The queries of the memory engine and their SQL."""

from memengine.plans import memory_queries, recall_queries

QUERIES = {**recall_queries.QUERIES, **memory_queries.QUERIES}
ORACLE = {**recall_queries.ORACLE, **memory_queries.ORACLE}
