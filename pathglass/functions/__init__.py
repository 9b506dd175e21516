"""Scalar functions: columns in, columns out, no Python on the executors."""
