"""Head-to-head event analytics and corpus preparation as composable Spark operators."""
