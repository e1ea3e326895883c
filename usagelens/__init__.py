"""Usage and cost analytics over request ledgers, written as Spark jobs."""
