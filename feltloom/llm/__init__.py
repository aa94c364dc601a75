"""Training-data operators.

Each module holds one operator; ``queries`` registers the ``opN_*`` queries.
Nothing outside this subpackage imports it.
"""
