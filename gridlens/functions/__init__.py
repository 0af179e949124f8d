"""Column-expression building blocks (no UDFs): rounding, calendar, tariff."""
