"""Training-data operators: mixing, scoring, privacy, secrets, quality, licences, near-duplicates, packing.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
registered queries, one per operator.
"""
