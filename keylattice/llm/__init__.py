"""Training-data operators on Spark: search, classification, extraction, tokens, joins and mixing."""
