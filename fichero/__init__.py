"""Document-to-registry analytics as Spark DataFrame jobs."""

from fichero.session import configure

__all__ = ["configure"]
