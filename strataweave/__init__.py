"""Point observations, polygon layers and raster layers joined and compared on Spark."""

from strataweave.session import build_session

__all__ = ["build_session"]
