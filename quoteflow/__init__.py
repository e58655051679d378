"""quoteflow: cross-exchange quote and trade analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` (parameters as
arguments) built from Catalyst expressions; Python runs only where a
sequential fold or keyed streaming state cannot be written as a column
expression.
"""

from quoteflow.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
