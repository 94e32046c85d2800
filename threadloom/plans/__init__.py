"""Compositions of operators: the engine, the index, exports and the registered queries."""
