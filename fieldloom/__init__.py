"""Quantitative analysis of image fields on Spark."""
