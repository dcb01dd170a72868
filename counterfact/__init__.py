"""Counterfactual text-bias analytics as Spark jobs."""

from counterfact.operators.dictionary import TermDictionary
from counterfact.session import get_session

__all__ = ["TermDictionary", "get_session"]
