"""tidemark: rare, short events in long sensor streams, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
