"""The log, extraction and admission jobs as Structured Streaming queries."""
