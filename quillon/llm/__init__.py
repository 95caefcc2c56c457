"""Operators that prepare training text: one module per problem, their queries in `queries`."""
