"""Readers and writers of corpora, queries, judgements, runs and jobs."""
