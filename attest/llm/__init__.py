"""Operators for preparing training data, each by a method of its own; nothing else imports them."""
