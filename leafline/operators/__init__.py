"""Operators: data frames in, data frame out."""
