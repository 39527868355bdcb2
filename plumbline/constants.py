"""Weights, limits, names and texts that results must carry verbatim."""

# --- Fixed values: quality scoring -------------------------------------------------
DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency")
DIMENSION_WEIGHTS = {
    "completeness": 0.30,
    "uniqueness": 0.25,
    "validity": 0.25,
    "consistency": 0.20,
}
CONCENTRATION_WEIGHT = 0.60
CONCENTRATION_CAP = 15.0
MEAN_SHARE = 0.50
HIGH_SEVERITY_PERCENT = 20
MEDIUM_SEVERITY_PERCENT = 5
SEVERITY_ORDER = ("high", "medium", "low", "info")
GRADES = ((95, "excellent"), (85, "good"), (70, "fair"))
LOWEST_GRADE = "needs_attention"
TOTAL_TOLERANCE = 0.02
TOTAL_TOLERANCE_SHARE = 0.001
NO_DISCOUNT_TEXTS = ("false", "0", "no")

# --- Fixed values: anomaly detection -----------------------------------------------
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
FOREST_CONTAMINATION = 0.01
FOREST_TREES = 100
FOREST_TREE_ROWS = 256
FOREST_MIN_ROWS = 20
DEFAULT_PAGE = 20
MAX_PAGE = 100
SEED = 42

# --- Fixed values: profile and distributions ---------------------------------------
DATE_PROBE_SHARE = 0.95
CATEGORY_MAX_DISTINCT = 50
CATEGORY_MAX_SHARE = 0.05
SAMPLE_VALUES = 5
TOP_VALUES = 5
HISTOGRAM_BINS = 24
TOP_CATEGORIES = 12
MAX_DISCRETE_VALUES = 12
MIN_DISCRETE_ROWS = 20
SHARE_MAX_GROUPS = 6
YEAR_BUCKET_SPAN = 3

# --- Fixed values: report examples -------------------------------------------------
REPORT_EXAMPLES = 5

# --- Fixed values: identifier name tokens ------------------------------------------
IDENTIFIER_TOKENS = ("id", "code", "number", "no")

# --- Fixed values: retail roles and the headers accepted for each ------------------
ROLE_HEADERS = {
    "transaction_id": ["InvoiceNo", "Invoice ID", "Invoice Number", "Transaction ID",
                       "Transaction No", "Order ID", "Order Number"],
    "quantity": ["Quantity", "Qty", "Units Sold", "Units Purchased"],
    "unit_price": ["UnitPrice", "Unit Price", "Price Per Unit", "Price/Unit", "Price Each",
                   "Item Price"],
    "product_id": ["StockCode", "Stock Code", "SKU", "Product ID", "Product Code", "Item Code"],
    "product_name": ["Description", "Product Description", "Product Name", "Item Description"],
    "line_total": ["Total Spent", "Line Total", "Line Amount", "Sales Amount", "Subtotal",
                   "Total"],
    "tax_amount": ["Tax 5%", "Tax Amount", "Sales Tax", "Tax Charged"],
    "discount_applied": ["Discount Applied", "Is Discounted"],
}
INVOICE_HEADER = "InvoiceNo"
QUANTITY_HEADER = "Quantity"
CANCELLATION_PREFIX = "C"

# --- Fixed values: texts a CSV field may hold for "missing" ------------------------
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: date formats understood by the date parser -----------------------
# Each entry is (shape of the text, format pattern).
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$", "d-M-yyyy H:mm"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)

# --- Fixed values: reasons and messages --------------------------------------------
# Issue sentences; figures and column names go between and into the parts.
MISSING_ISSUE = (" is missing in ", "% of records.")
DUPLICATES_ISSUE = " duplicate rows were detected."
MALFORMED_ISSUE = (" contains ", " nonnumeric or non-finite values.")
DESCRIPTIONS_ISSUE = "{} values associated with multiple {} values were detected."
TOTALS_ISSUE = " comparable {} values differ from {}."
# Shapes of report names: file suffixes that are cut off, characters that file names may not have.
REPORT_NAME_SUFFIX_PATTERN = r"(?i)\.(csv|xlsx)$"
REPORT_NAME_ILLEGAL_PATTERN = r'[<>:"/\\|?*\x00-\x1f]'
NO_FIELDS_REASON = "No usable fields"
NO_ROWS_REASON = "The dataset has no data rows."
CONCENTRATED_REASON = "Concentrated missing values reduce the score by up to 15 points."
NOT_CONCENTRATED_REASON = "No extra deduction for concentrated missing values."
VALIDITY_MISSING_REASON = "Retail validity requires quantity and unit price fields. Missing: {}."
VALIDITY_EMPTY_REASON = "Quantity and unit price contain no values to validate."
VALIDITY_CANCELLATION_REASON = (
    "Quantity and price formats and negative prices checked; "
    "the UK C-invoice cancellation rule also applies."
)
VALIDITY_GENERIC_REASON = (
    "Quantity and price formats and negative prices checked. Negative quantities require "
    "business context and are not automatically scored as errors."
)
CONSISTENCY_MISSING_REASON = (
    "Retail consistency requires comparable product ID/description pairs "
    "or quantity, unit price, and line total values."
)
CONSISTENCY_REASON = (
    "Average of the evaluated retail consistency rules; each rule lists its comparison count "
    "and matched columns."
)
NEGATIVE_QUANTITY_ISSUE = (
    "Negative quantities without cancellation-style invoice numbers were detected."
)
NEGATIVE_PRICE_ISSUE = "Negative unit prices were detected."
ZERO_PRICE_ISSUE = "Zero-priced records were found and require business-context review."
TOO_FEW_VALUES_REASON = "At least four finite values and two distinct values are required."
ZERO_IQR_REASON = "The interquartile range is zero."
ZERO_DEVIATION_REASON = "The standard deviation is zero or non-finite."
NONFINITE_BOUNDS_REASON = "The calculated bounds are non-finite."
FOREST_GATE_REASON = (
    "At least two varying numeric fields and 20 complete rows are required."
)
FOREST_EVIDENCE = (
    "The combination of these numeric values is unusual relative to the model's training sample. "
    "The model does not identify which field caused the flag."
)
ANOMALY_MESSAGE = "An anomaly is an unusual observation, not proof of a data-quality error."
NO_FINITE_REASON = "No finite numeric values are available."
NO_DATES_REASON = "No valid dates are available."
NO_CATEGORIES_REASON = "No nonmissing category values are available."
NOT_SUMMARIZED_REASON = "Identifier and free-text fields are not summarized as distributions."
CSV_EXTENSION = ".csv"
EXTENSION_REASON = "Only .csv files can be ingested."
UNREADABLE_REASON = "The uploaded file could not be read: "
EMPTY_UPLOAD_REASON = "The uploaded dataset must contain at least one data row."

# --- Fixed values: row interpretations (category, from a business rule, message, next step)
NEGATIVE_PRICE_READING = (
    "possible_data_quality_issue", True,
    "Negative unit price conflicts with the current retail validity rule.",
    "Check the source price and the transaction context.",
)
RETURN_READING = (
    "possible_legitimate_return", True,
    "Cancellation-style invoice: a negative quantity may be a legitimate return.",
    "Confirm the cancellation or return in the source transaction.",
)
NEGATIVE_QUANTITY_READING = (
    "possible_data_quality_issue", True,
    "Negative quantity without a cancellation marker needs investigation.",
    "Check whether this is a return recorded without the usual invoice marker.",
)
ZERO_PRICE_READING = (
    "needs_business_review", True,
    "Zero price may be a promotion, free item, or data issue.",
    "Check the product and transaction context before judging it.",
)
FLAGGED_READING = (
    "needs_review", False,
    "The value is unusual, but no configured business rule establishes an error.",
    "Compare the row with the source record and nearby observations.",
)
NOT_EVALUATED_READING = (
    "not_evaluated", False,
    "No anomaly method could evaluate this dataset.",
    "Check whether the dataset has usable numeric fields.",
)
NO_SIGNAL_READING = (
    "no_anomaly_signal", False,
    "No available anomaly method flagged this row; this does not certify it as correct.",
    "Use the quality assessment for separate data-quality evidence.",
)

# --- Fixed values: report sentences -------------------------------------------------
NO_GRADE = "No overall grade"
GRADE_SUFFIX = " by configured checks"
MATCHES_NOTE = ("Retail field matches: ", ". Ambiguous names are excluded from retail rules.")
INPUTS_NOTE = (
    "Retail validity had complete quantity and price inputs for ", " rows (",
    "% of the dataset). Missing inputs are covered by completeness.",
)
COMPARISONS_NOTE = ("Retail consistency comparisons: ", ".")
CONCENTRATION_NOTE = (
    "Completeness starts from ", " / 100 filled-cell coverage. ", " is missing in ",
    "% of rows, so concentrated missingness deducts ",
    " points from the completeness dimension (maximum 15).",
)

# --- Fixed values: display labels --------------------------------------------------
METHOD_LABELS = {"iqr": "IQR", "z_score": "Z-score", "isolation_forest": "Isolation Forest"}
REPORT_NAME_PREFIX = "Data Quality Report - "
REPORT_NAME_SUFFIX = ".pdf"
REPORT_NAME_DEFAULT = "Dataset"
REPORT_NAME_LENGTH = 100
