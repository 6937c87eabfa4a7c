"""panelspark: Spark-native operators for longitudinal panels (entities x dated episodes)."""

from .spec import DEFAULT, PanelSpec  # noqa: F401

__version__ = "0.1.0"
