"""Change-coupling analytics as Spark plans."""
