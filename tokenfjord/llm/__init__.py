"""Operators for preparing training data at scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when the folder is present.
"""
