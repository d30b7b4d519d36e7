"""askbook: asking-price market analytics as DataFrame operators on Spark."""
