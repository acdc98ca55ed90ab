"""glenfare: trip-demand analytics as Spark DataFrame operators.

Every public operator takes a trips ``DataFrame`` (see
``glenfare.sources.schema.TRIP_SCHEMA``) and returns a lazy ``DataFrame``;
nothing is collected to the driver except bounded one-row results that a
caller explicitly asks for.
"""

from glenfare.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
