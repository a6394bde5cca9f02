"""Operators of a training-data pipeline: tokens, duplicates, licences, urls, personal data, languages, quality and packing.

Nothing outside this subpackage imports it. Each operator's module states what it does with null and empty texts,
ties, repeated rows and empty tables; ``queries`` registers one thin query for each.
"""
