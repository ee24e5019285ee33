"""Formula text to plan: lexer, parser, binder, lowering."""
