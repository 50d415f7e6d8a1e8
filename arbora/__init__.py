"""arbora: semantic retrieval over Gaussian concept trees, expressed as Spark jobs."""

__version__ = "0.1.0"
