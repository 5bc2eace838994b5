"""Spark-native operators that turn raw activity events into explainable comparisons."""
