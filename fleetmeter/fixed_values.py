"""Fixed values.

Everything here is data that results must carry literally: source names, labels,
word lists, page sizes and scale letters. Nothing else in the package repeats them.
"""

# --- fixed values: fact sources -------------------------------------------------
HOUR_SOURCE = "hm_record"
COST_SOURCE = "good_consume"

# --- fixed values: labels -------------------------------------------------------
UNKNOWN_CATEGORY = "Unknown Category"
RESET_FLAG = "true"
RESET_MESSAGE = " hour meter is reset"

# --- fixed values: service status, in display order -----------------------------
NEEDED = "Needed service"
INCOMING = "Incoming Service"
GOOD = "Good condition"
NOT_REGISTERED = "Product not registered in good consume record"
STATUSES = [NEEDED, INCOMING, GOOD, NOT_REGISTERED]
INCOMING_HOURS = 24

# --- fixed values: page and list sizes ------------------------------------------
DISTRIBUTION_PAGE = 10
REPORT_PAGE = 20
TOP_ASSETS = 10
SUBCATEGORY_CLUSTERS = 1000

# --- fixed values: number suffixes, power of ten to letter ----------------------
PRICE_PREFIX = "Rp "
SCALES = [(12, "T"), (9, "M"), (6, "jt"), (3, "rb")]

# --- fixed values: brand words removed from product names -----------------------
BRANDS = [
    "toyota", "mitsubishi", "hino", "dongfeng", "mazda", "ford", "hilux",
    "suzuki", "triton", "strada", "dutro", "bridgestone", "innova", "avanza",
    "luxio", "liugong", "yukimura", "weichai",
]

# --- fixed values: columns of the two facts that hold upstream period labels ----
PERIOD_COLUMNS = {
    "day": "date_only",
    "week": "week_column_1",
    "month": "month_column_1",
    "quarter": "quarter_column_1",
    "semester": "semester_column_1",
    "year": "year_column",
}

# Patterns of name cleaning.
WORD_WITH_DIGIT = r"\b\w*\d\w*\b"
NO_LETTER = r"[^a-zA-Z\s]"
BLANKS = r"\s+"
