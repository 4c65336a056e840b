"""Training-data operators: tokenisation, deduplication, filtering, mixing,
archives and vector search.  Nothing outside this package imports it."""
