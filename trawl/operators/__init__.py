"""Stage operators on ranked runs: search, dedup, rerank, fuse, evaluate."""
