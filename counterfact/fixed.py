"""Word list, grid settings and constants that results depend on."""

# The paired terms, one pair a line.
PAIRED_TERMS = """
he she
him her
his hers
man woman
men women
boy girl
boys girls
father mother
fathers mothers
son daughter
sons daughters
brother sister
brothers sisters
uncle aunt
uncles aunts
husband wife
husbands wives
actor actress
actors actresses
king queen
kings queens
waiter waitress
waiters waitresses
prince princess
princes princesses
mr. mrs.
mr mrs
male female
males females
gentleman lady
gentlemen ladies
businessman businesswoman
businessmen businesswomen
boyfriend girlfriend
boyfriends girlfriends
stepfather stepmother
stepfathers stepmothers
spokesman spokeswoman
spokesmen spokeswomen
hero heroine
heroes heroines
grandson granddaughter
grandsons granddaughters
"""

# Pairs of frequent words, for corpora in which the terms above are rare.
FREQUENT_TERMS = """
the this
is was
of to
he she
king queen
"""

# The experiment grid.
SEEDS = (0, 1, 2, 3, 4)
P_ENV_A = ("0.1", "0.25", "0.5", "0.7", "0.9")
METHODS = ("eLM", "iLM")
STEPS_PER_RUN = 2500
BATCH_SIZE = 16
EVAL_BATCH_SIZE = 8
ACCUMULATION = 3

# Smoothing values; they take the place of the learning rate as the fourth grid dimension.
ALPHAS = ("0.1", "0.5")

# Names of environments and splits.
ENV_A = "env_A"
ENV_B = "env_B"
POOLED_ENV = "all_train"
NO_ENV = "erm"
VAL_PREFIX = "val_"

# Preparation and reporting.
MASK_SHARE = 0.15
MAP_BATCH_ROWS = 1000
MODEL_LENGTH_LIMIT = 1024
LOG_INTERVAL = 200
LOSS_GUARD = 100.0
PROBABILITY_FLOOR = 1e-8
DEFAULT_RATE = "1e-5"
IGNORED_LABEL = -100

MASK = "[MASK]"
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIAL_TOKENS = (PAD, UNK, CLS, SEP, MASK)
LINE_START = "<s>"
LINE_END = "</s>"

# Characters that Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
