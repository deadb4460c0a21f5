"""DataFrame operators: vectors, quality gates, reference graphs, registries."""
