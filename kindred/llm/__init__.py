"""Operators for building training data, their registered queries and the corpus pipeline's parts."""
