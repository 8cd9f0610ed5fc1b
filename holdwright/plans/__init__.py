"""Whole jobs: the read models, the resolver and their inputs."""
