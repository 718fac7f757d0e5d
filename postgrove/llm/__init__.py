"""Operators for preparing training data at corpus scale. Nothing outside this folder imports them."""
