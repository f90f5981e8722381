"""Sources and sinks. Products are chosen by file name and priority; users register their own."""

from . import extracted  # noqa: F401  registers its products
from .products import PRODUCTS, Product, read, register, variables

__all__ = ["PRODUCTS", "Product", "read", "register", "variables"]
