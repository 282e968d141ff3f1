"""Pull-request and text analytics as composable DataFrame -> DataFrame operators."""
