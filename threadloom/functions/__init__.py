"""Column functions: tokens, compact text, counting, rendering and redaction."""
