"""tallyframe: Spark-native operators for the data work around local model
operations (retrieval, contract validation, bench roll-ups, event monitoring,
file inventory, tensor catalogs and vector block codecs).

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
builder) expressed with Spark SQL expressions so Catalyst plans it; Arrow
pandas UDFs are used only where no built-in expression exists.
"""

from tallyframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
