"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this package imports it; it only depends on Spark, Arrow and numpy.
"""
