"""Security analysis of source code and text, expressed as Spark jobs."""
