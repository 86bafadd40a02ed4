"""Operators of a training-data pipeline: one module per operator, each with its general
DataFrame function and the thin ``opN_<name>`` query that applies it to a whole table."""
