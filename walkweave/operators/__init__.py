"""DataFrame operators: graphs, walks, contact maps, likelihoods, distances, inference."""
