"""Operators for preparing training data: one module each, their catalogue in ``queries``."""
