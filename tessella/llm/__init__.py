"""Operators that prepare training text at corpus scale. Nothing outside this folder imports them."""
