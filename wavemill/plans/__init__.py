"""Encoders, learners and estimators."""
