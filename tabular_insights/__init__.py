"""Profiling, preparing and classifying large labelled incident tables on Spark."""
