"""Operators for preparing training text, built to run over whole corpora on many executors."""
