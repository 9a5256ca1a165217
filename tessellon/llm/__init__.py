"""Training-data operators: packing, search, extraction, filters, tokenising, joins, language, chat, archives, quality."""
