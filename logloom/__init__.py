"""Log analytics as Spark DataFrame transformations."""

from logloom.session import get_session, utc

__all__ = ["get_session", "utc"]
