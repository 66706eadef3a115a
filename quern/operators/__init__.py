"""Relational, graph, sampling, metric and segmentation operators."""
