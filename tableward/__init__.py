"""Data and model reliability checks expressed as Spark DataFrame plans."""

from tableward.session import build_session

__all__ = ["build_session"]
