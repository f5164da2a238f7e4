"""Matrix operators: filtering, normalising, statistics, tests, graphs and embeddings."""
