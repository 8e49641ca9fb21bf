"""Column-level building blocks: ranks, standardising, modes, geometry, tail probabilities."""
