"""Training-data operators: ten dealt operators and their registered queries.

Nothing outside this subpackage imports it. ``registry`` lists the queries and
their SQL; every operator module keeps its own general interface.
"""
