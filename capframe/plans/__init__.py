"""Whole runs made of operators: preparation, inference, baselines, run matrix."""
