"""trialscope: judgment and decision analytics as Spark DataFrame jobs."""
__version__ = "0.1.0"
