"""Reports, searches, bulk changes and order intake: ``f(frames…, parameters) -> frame``."""
