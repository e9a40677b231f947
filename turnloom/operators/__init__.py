"""DataFrame operators: dataset building, overlap scores, retrieval, statistics, comparison."""
