"""The query modules, imported so that they register themselves."""

from exonloom.plans import annotation_queries, counting_queries, join_queries, model_queries, network_queries, order_queries, read_queries, scoring_queries, selection_queries, stat_queries, token_queries  # noqa: F401
