"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from tabscore.functions.hashing import hash32, unit_hash
from tabscore.functions.linear import LinearModel, margin, probability, predicted_label

__all__ = ["hash32", "unit_hash", "LinearModel", "margin", "probability", "predicted_label"]
