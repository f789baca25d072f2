"""Transit arrival analytics as composable Spark DataFrame operators."""
