"""The registered queries: each names an operator, the tables it reads, and an equivalent SQL text to check it."""
