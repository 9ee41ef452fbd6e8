"""gridpace: race-timing and strategy analytics as Spark jobs over lap tables."""
