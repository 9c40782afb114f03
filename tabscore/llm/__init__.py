"""Operators for preparing training text, each a module of its own.

Nothing outside this folder imports it.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the top of the repository chains five
of them over ``documents``.
"""
