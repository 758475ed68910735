"""Training-data operators: each module has one operator with a general interface.

The thin ``opN_*`` queries are in :mod:`tarn.llm.queries`; nothing outside this
subpackage imports it.
"""
