"""Operators for text and matching problems of training data. Nothing outside this package imports it."""
