"""Training analytics over DataFrames: session load, form, readiness, risk, plans and the tables around them."""

__version__ = "0.1.0"
