"""tracemill.plans"""
