"""Detectors, wranglers, bins, histograms, scatter samples, summaries and predicates over DataFrames."""
