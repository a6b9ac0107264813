"""Operators on documents: detection, resolution, policy, validation, grounding, evaluation, layout."""
