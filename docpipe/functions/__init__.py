"""Expression operators; importing the package registers all of them."""

from . import arithmetic, arrays, convert, dates, logic, strings
from .core import OPERATORS, Scope, V, compile_expr

__all__ = ["OPERATORS", "Scope", "V", "arithmetic", "arrays", "compile_expr", "convert", "dates", "logic", "strings"]
