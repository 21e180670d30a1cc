"""Operators for preparing large text corpora on Spark; nothing else in the package imports this."""
