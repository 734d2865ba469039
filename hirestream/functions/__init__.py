"""Column-level functions (no UDFs): salary, time, text, vectors, status, mail."""
