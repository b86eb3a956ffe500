"""Classifiers, kernel maps and factor analysis."""
