"""The operator registry: names, input tags, result tags and column functions."""

from .registry import REGISTRY, Operator, list_operators, list_operators_by_category, register_operator

__all__ = ["REGISTRY", "Operator", "list_operators", "list_operators_by_category", "register_operator"]
