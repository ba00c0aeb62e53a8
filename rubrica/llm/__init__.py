"""Operators of a training-data pipeline: scoring, archives, search, quality, secrets, mixing, language, joins, packing, chats."""
