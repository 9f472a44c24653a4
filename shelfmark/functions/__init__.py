"""Scalar rules: Column in, Column out, all evaluated by Spark's own expressions."""
