"""Training-data operators: mixing, PII, URL filters, deduplication, similarity
joins, classification, search and tokenization, each a Spark job.

Nothing else in the library imports this subpackage. Every module defines the
operator (general interface) and a thin ``op<N>_<name>`` query; ``registry``
collects the queries and their DuckDB oracles.
"""
