"""Tradewind: e-commerce analytics as Spark DataFrame operators."""

from tradewind.params import Params
from tradewind.sources.schemas import RawTables, StarSchema

__all__ = ["Params", "RawTables", "StarSchema"]
