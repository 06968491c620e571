"""Column expressions and the few Arrow functions the operators need."""
