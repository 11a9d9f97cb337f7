"""Operators for preparing text corpora and embedding tables for model training.

Nothing outside this folder imports it.
"""
