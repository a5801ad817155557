"""Training-data operators: cleaning, deduplication, packing, tokenising, scoring.

Every operator lives in a module of its own; :mod:`ordinex.llm.queries` binds
them to the tables of a data folder.
"""
