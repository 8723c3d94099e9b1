"""The data contract: column names, label sets and published defaults."""

from __future__ import annotations

# --- fixed values: prepared-table columns, in output order -----------------
TEXT_COLUMNS = [
    "review_text",
    "business_name",
    "business_categories",
    "business_city",
    "business_state",
    "user_name",
]
COMPLIMENTS = [
    "hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos",
]
NUMERIC_COLUMNS = [
    "review_useful", "review_funny", "review_cool",
    "business_stars", "business_review_count", "business_is_open",
    "business_latitude", "business_longitude",
    "user_review_count", "user_useful", "user_funny", "user_cool", "user_fans", "user_average_stars",
    *(f"user_compliment_{kind}" for kind in COMPLIMENTS),
]
SCORE = "score_label"
POLARITY = "polarity_label"
PREPARED_COLUMNS = [*TEXT_COLUMNS, *NUMERIC_COLUMNS, SCORE, POLARITY]

# --- fixed values: raw name -> prepared name -------------------------------
REVIEW_NAMES = {
    "text": "review_text",
    "stars": SCORE,
    **{vote: f"review_{vote}" for vote in ("useful", "funny", "cool")},
}
BUSINESS_NAMES = {
    raw: f"business_{raw}"
    for raw in (
        "name", "categories", "city", "state", "stars", "review_count", "is_open", "latitude", "longitude",
    )
}
USER_NAMES = {
    raw: f"user_{raw}"
    for raw in (
        "name", "review_count", "useful", "funny", "cool", "fans", "average_stars",
        *(f"compliment_{kind}" for kind in COMPLIMENTS),
    )
}
USER_SCAN_EXCLUDES = ("friends", "latitude", "longitude")

# --- fixed values: tokens the CSV reader takes as missing ------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: labels --------------------------------------------------
POLARITY_WORDS = {"negative": -1, "neutral": 0, "positive": 1}
POLARITIES = [-1, 0, 1]
SCORES = [1, 2, 3, 4, 5]
ASPECTS = ["food", "service", "price", "cleanliness", "ambience", "location"]

# --- fixed values: split and model defaults --------------------------------
TRAIN_FRACTION = 0.9
SEED = 67
LABELLING_LIMIT = 100
ERROR_PREFIX = "__ERROR__: "
LOGISTIC = {"C": 1.0, "max_iter": 200, "tol": 1e-4}
SVM = {"C": 1.0, "tol": 1e-3, "max_iter": 2000, "max_rows": 100_000}
FOREST = {"trees": 100, "depth": 30, "min_leaf": 2}
PERCEPTRON = {"hidden": [128, 256, 128], "max_iter": 100}
ENCODER_FRACTION = 0.1  # asked for by name, see training.encoded_rows
ENCODER_BATCH = 64
