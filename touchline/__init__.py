"""touchline: sports analytics as Spark DataFrame operators."""
