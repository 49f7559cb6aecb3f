"""trawl: text retrieval, evaluation and corpus preparation as Spark plans."""
