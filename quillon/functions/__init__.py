"""Column functions: native expressions first, Arrow functions only for Unicode normal forms."""
