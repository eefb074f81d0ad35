"""Querying HTML, URLs, embedded JSON and network logs at corpus scale with Spark."""
