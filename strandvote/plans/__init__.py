"""Stages composed of operators, and their parameters."""
