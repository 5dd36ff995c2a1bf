"""Fixed values shared by the operators.

They fix what the numbers mean (missing-value words, sequence width, learning
rate and so on), so they are stated once, here.
"""

# Words the CSV convention reads as a missing text.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Fixed value: how a missing text reads once it is cast to a string.
MISSING_TEXT = "nan"

# Reserved vocabulary entries and sequence shape.
UNKNOWN_TOKEN, UNKNOWN_INDEX = "<UNK>", 0
PADDING_TOKEN, PADDING_INDEX = "<PAD>", 1
VOCABULARY_CAP = 200_000
SEQUENCE_LENGTH = 30

# Two-class regression on pair features.
TRAIN_FRACTION = 0.8
REGRESSION_RATE = 0.06
REGRESSION_EPOCHS = 100
BATCH_SIZE = 1_000
SCORE_CHUNK = 100_000

# Distance head and batch normalisation.
DISTANCE_THRESHOLD = 0.7
NORM_EPSILON = 1e-3
MIN_PROBABILITY = 1e-15

# The logistic curve rounds to exactly 1.0 in double precision from here on.
SIGMOID_SATURATES_AT = 37

# Named feature sets.
BASIC3 = ("cosine", "edit_sig", "common")
ALL5 = ("cosine", "edit_sig", "common", "len1", "len2")
