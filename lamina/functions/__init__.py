"""Scalar functions and the models built on them."""
