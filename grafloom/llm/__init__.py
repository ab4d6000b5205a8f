"""Training-data operators: quality, dedup, mixing, sharding, extraction, tokenising, search.

Nothing outside this subpackage imports it.  ``queries.py`` binds every
operator to its thin ``opN_<name>`` query.
"""
