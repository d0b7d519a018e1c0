"""Scalar functions on columns: vector kernels, quantisation, text and filters."""
