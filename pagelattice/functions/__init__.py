"""Column expressions: URLs, text, markup."""
