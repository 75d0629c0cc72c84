"""Column expressions: text normalisation and the record's timestamp format."""
