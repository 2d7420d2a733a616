"""Whole reports: read the artefacts, run the operators, publish, decide."""
