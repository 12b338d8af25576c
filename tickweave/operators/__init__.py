"""Indicators, statistics, features, labels and evaluation, as DataFrame transformations."""
