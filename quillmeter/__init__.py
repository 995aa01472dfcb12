"""quillmeter: a Spark-first analytics engine for request-level usage logs."""

__version__ = "0.1.0"
