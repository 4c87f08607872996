"""Training-data operators: near duplicates, licences, tokens, scores, packing, quality and language.

Nothing outside this package imports it.  Every module holds one operator with
its own general interface; ``queries`` derives the registered digest queries.
"""
