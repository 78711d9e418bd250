"""Query text to logical plan: lexer, parser, canonical form, validation, lowering. No Spark here."""
