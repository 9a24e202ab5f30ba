"""Operators of the algorithms and texts that language-model data needs; nothing else imports this."""
