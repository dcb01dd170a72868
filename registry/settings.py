"""Settings shared by the registered queries and their SQL."""

from counterfact import fixed
from counterfact.operators.dictionary import TermDictionary
from counterfact.plans.grid import Grid

SEED = 0
P = "0.25"
ALPHA = "0.1"
BLOCK = 128
RANKS = 4
CHECKPOINT_EVERY = 500
LOG_RUNS_EPOCH = 1000

# Terms for the text operators, and for the estimators.
ALL_TERMS = TermDictionary.from_text(fixed.PAIRED_TERMS + fixed.FREQUENT_TERMS)
FREQUENT = TermDictionary.frequent()

ONE_CELL = Grid((SEED,), (P,), (ALPHA,))
SMALL = Grid((0, 1), ("0.25", "0.5"), ("0.1", "0.5"))
FULL = Grid()
