"""Spark jobs for rule-guided case corpora: cleaning, audit, graph, retrieval, comparison, sessions, evaluation."""
