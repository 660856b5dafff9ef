"""Operations of a training-data pipeline: search, filters, dedup, mixing, tokens.

Nothing else in this package imports this subpackage.
"""
