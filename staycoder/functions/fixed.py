"""These must equal the specified behaviour for results to be right."""

# Patterns. (?U) keeps \b, \s and \w Unicode-aware on every JDK.
WORD = r"(?U)\b[\p{L}\p{N}][\p{L}\p{N}\-_/]*\b"
SENTENCE_BREAK = ".!?;"  # any of these, or a line break
UPPER_ABBREVIATION = r"(?U)\b[A-ZÀ-Ý0-9]{2,}\b"
DOTTED_ABBREVIATION = r"(?U)\b(?:[A-Za-z]\.){2,}[A-Za-z]?\b"
ICD10 = r"(?U)\b[A-TV-Z][0-9]{2}(?:\.[0-9A-TV-Z]{0,4})?\b"
ANSWER_MARK = "DP:"

# Metric names, in report order.
METRICS = ("len_chars", "len_words", "sent_len_avg", "lexicon_size", "n_sections", "n_abbr")

# What Python's str.strip() removes, as the inside of a Java character class (to be used with (?U)).
WS = r"\s\x1c-\x1f"

# CSV fields that pandas.read_csv takes as missing (the empty field too).
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Default column names of inputs and outputs.
COL_TEXT = "text"
COL_STAY = "code_sejour"
COL_PATIENT = "code_patient"
COL_GOLD = "code_dp"
COL_PREDICTION = "dp_predit"
