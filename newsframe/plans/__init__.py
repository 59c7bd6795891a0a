"""Step lists, presets, models, metrics and experiment runs built from the operators."""
