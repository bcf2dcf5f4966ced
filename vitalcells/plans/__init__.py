"""Analyses assembled from the operators: studies, reconciliation, report tables, relevance."""
