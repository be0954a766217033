"""Domain pipelines: pieces, capacities, user overrides, results, views and comparisons."""
