"""marlpit: a PySpark-native analytics engine."""

from marlpit.session import Engine, build_session

__all__ = ["Engine", "build_session"]
__version__ = "0.1.0"
