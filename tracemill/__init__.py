"""tracemill: analytics over multi-agent conversation traces, expressed as Spark plans."""
