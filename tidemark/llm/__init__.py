"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers them for the driver.
"""
