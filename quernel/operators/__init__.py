"""The table operators."""

from quernel.operators.basic import cut, keep, melt, mutate, sort, take
from quernel.operators.join import join
from quernel.operators.reshape import info, pivot
from quernel.operators.summarize import summarize

__all__ = ["cut", "info", "join", "keep", "melt", "mutate", "pivot", "sort", "summarize", "take"]
