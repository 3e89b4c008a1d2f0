"""oddsmill: a Spark-first analytics engine for binary-outcome market data."""
