"""Decision-log and dialogue-log analytics as Spark DataFrame transforms."""
