"""Training-data operators: language, secrets, quality, HTML, pieces, decontamination, PII, toxicity, joins, chat.

Nothing outside this subpackage imports it.
"""
