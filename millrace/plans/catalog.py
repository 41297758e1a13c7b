"""Every query of the core: name to callable, and name to DuckDB SQL."""

from millrace.plans import corpus_queries, dedup_chat_queries, graph_eval_queries, io_queries, retrieval_queries, scoring_queries, text_queries, token_queries

MODULES = [text_queries, scoring_queries, io_queries, token_queries, dedup_chat_queries, graph_eval_queries, corpus_queries, retrieval_queries]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
