"""Inference of models, the planner, and metadata."""
