"""Training-data operators: joins, dedup, decontamination, tokens, models.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator.
"""
