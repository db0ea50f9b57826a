"""The SQL dialect: tokens, parser, lowering to DataFrames."""
