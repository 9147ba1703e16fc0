"""tracemill.streaming"""
