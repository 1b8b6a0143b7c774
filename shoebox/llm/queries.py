"""Queries of the operators for training data."""

from shoebox.llm import q_clusters, q_contamination, q_groups, q_mixing, q_neighbours, q_scans, q_splitting, q_truth

MODULES = [q_scans, q_truth, q_groups, q_neighbours, q_clusters, q_contamination, q_mixing, q_splitting]
