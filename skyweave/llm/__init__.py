"""Training-data operators: tokenise, pack, deduplicate, decontaminate, shard, scan, identify, score, search.

Nothing else in the library imports this subpackage.
"""
