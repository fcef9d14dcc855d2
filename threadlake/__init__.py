"""threadlake: discussion-thread and media-archive work as Spark DataFrame jobs."""

__version__ = "0.1.0"
