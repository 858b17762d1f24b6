"""Lexers, a packrat parser for parsing-expression grammars, and grammars of eight languages."""
