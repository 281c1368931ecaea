"""Flight-level delay classification: features, models, evaluation, explanation."""
