"""Fixed values.

Everything in this module must equal the published behaviour exactly: word
lists, lookup tables, limits, weights, patterns and message formats.
"""

# --- keyword extraction (fixed values) --------------------------------------
STOPWORDS = """
a an the and or but in on at to for of with by from is are was were be been
being have has had do does did will would could should may might must shall
can need this that these those it its as if then than so such both each few
more most other some any no not only own same very just also now here there
when where why how all about into over after before between under again
further once during while through what which who whom whose your you we they
""".split()

BUSINESS_TERMS = """
price cost product service hours location contact email phone website
description features specifications menu booking reservation payment delivery
shipping
""".split()

EMAIL_IN_TEXT = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_IN_TEXT = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
URL_IN_TEXT = r"https?://\S+"
PRICE_IN_TEXT = r"\$[\d,]+(?:\.\d{2})?"
CAPITALISED_WORD = r"\b[A-Z][a-z]+\b"

SYNONYMS = {
    "price": ["cost", "rate", "fee", "charge"],
    "hours": ["time", "schedule", "timing", "open"],
    "location": ["address", "place", "where", "near"],
    "contact": ["phone", "email", "reach", "call"],
    "product": ["item", "goods", "merchandise"],
    "service": ["offering", "package", "tour"],
}

# --- relevance, snippets and retrieval (fixed values) -----------------------
HIT_WEIGHT = 0.2
HIT_WEIGHT_CAP = 0.6
BUSINESS_BONUS = 0.2
HEAD_BONUS = 0.2
HEAD_CHARS = 500
SNIPPET_SIDE_CHARS = 100
DEFAULT_TOP_PAGES = 5
CONFIDENCE_PER_PAGE = 0.1
CONFIDENCE_PAGE_CAP = 0.3
SIGNAL_WEIGHTS = {"relevance": 0.5, "coverage": 0.3, "snippet": 0.2}

# --- archives and files (fixed values) --------------------------------------
MAX_ARCHIVE_BYTES = 524288000
MAX_ARCHIVE_MEMBERS = 100
MAX_COMPRESSION_RATIO = 1000

TYPE_BY_EXTENSION = {
    ".pdf": "pdf", ".doc": "doc", ".docx": "docx",
    ".xls": "xls", ".xlsx": "xlsx", ".csv": "csv",
    ".jpg": "jpg", ".jpeg": "jpeg", ".png": "png", ".gif": "gif", ".webp": "webp",
    ".mp4": "mp4", ".avi": "avi", ".mov": "mov", ".mkv": "mkv",
}

TYPE_BY_MIME = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/csv": "csv",
    "text/comma-separated-values": "csv",
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "video/mp4": "mp4",
    "video/x-msvideo": "avi",
    "video/quicktime": "mov",
    "video/x-matroska": "mkv",
}

# hexadecimal prefixes of the first 16 bytes
TYPE_BY_MAGIC = {
    "25504446": "pdf",
    "D0CF11E0A1B11AE1": "doc",
    "FFD8FF": "jpg",
    "89504E470D0A1A0A": "png",
    "474946383761": "gif",
    "474946383961": "gif",
}
ZIP_MAGIC = "504B0304"
RIFF_MAGIC = "52494646"
RIFF_KIND = {"41564920": "avi", "57454250": "webp"}

CATEGORY_TYPES = {
    "document": ["pdf", "doc", "docx"],
    "spreadsheet": ["xls", "xlsx", "csv"],
    "image": ["jpg", "jpeg", "png", "gif", "webp"],
    "video": ["mp4", "avi", "mov", "mkv"],
}

# --- tables on pages (fixed values) -----------------------------------------
TABLE_HEADER_WORDS = {
    "pricing": "price cost rate amount fee charge total subtotal".split(),
    "itinerary": "day time date schedule itinerary duration when".split(),
    "specifications": (
        "spec specification feature dimension weight size material color model type description"
    ).split(),
    "menu": "dish item food meal course appetizer main dessert beverage menu".split(),
    "inventory": "stock quantity available inventory count units remaining".split(),
}
CURRENCY_IN_CELLS = r"[\$€₹]\s*\d+[\d,.]*"
TIME_IN_CELLS = r"(day\s*\d+|\d{1,2}:\d{2}\s*[ap]m)"
MIN_FILLED_RATIO = 0.3
TABLE_CONTEXT_CHARS = 500

# --- images (fixed values) ---------------------------------------------------
RESOLUTION_LEVELS = [
    (1920 * 1080, "high", 1.0),
    (1280 * 720, "medium", 0.7),
    (640 * 480, "low", 0.5),
    (0, "very_low", 0.3),
]
ALTERNATIVE_RESOLUTION_SCORES = [(1920 * 1080, 1.0), (1280 * 720, 0.8), (640 * 480, 0.6), (0, 0.4)]
STANDARD_RATIOS = [16 / 9, 4 / 3, 1.0, 3 / 2]
IMAGE_FORMATS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "gif": "gif", "bmp": "bmp", "webp": "webp"}
NEAR_DUPLICATE_BITS = 5
IMAGE_CATEGORIES = ["product", "service", "food", "destination", "person", "document", "logo", "other"]

# --- prompts and answers (fixed values) --------------------------------------
SERVICE_WORDS = ["trek", "hike", "expedition", "adventure"]
PRODUCT_WORDS = ["product", "item", "buy", "sell"]
TYPE_SAMPLE_DOCS, TYPE_SAMPLE_CHARS = 2, 1000
COMPANY_SAMPLE_DOCS, COMPANY_SAMPLE_CHARS, COMPANY_PROMPT_CHARS = 3, 2000, 4000
SERVICE_PROMPT_CHARS = 7000
MIN_SERVICE_TEXT_CHARS = 100
IMAGE_CONTEXT_CHARS = 500
IMAGE_METHOD_NOTES = {
    "embedded_pdf": "\n\nNote: This image was embedded in a business document.",
    "embedded_docx": "\n\nNote: This image was embedded in a Word document.",
}

# --- profile checks (fixed values) --------------------------------------------
EMAIL_ADDRESS = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
WEB_ADDRESS = r"^https?://[^\s]+$"
MIN_PHONE_DIGITS = 7
MIN_DESCRIPTION_CHARS = 20
HIGH_PRICE = 1000000
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# --- jobs (fixed values) --------------------------------------------------------
PHASE_PROGRESS = {
    "file_discovery": 10.0,
    "document_parsing": 30.0,
    "table_extraction": 50.0,
    "media_extraction": 70.0,
    "indexing": 85.0,
    "schema_mapping": 95.0,
    "done": 100.0,
}

# --- MIME types guessed from a file name (fixed values) ---------------------------
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mov": "video/quicktime",
    ".mkv": "video/x-matroska",
    ".dot": "application/msword",
    ".jpe": "image/jpeg",
    ".qt": "video/quicktime",
}

# What an assembled profile says about its making: fixed values.
PROFILE_CONFIDENCE = 0.8
EXTRACTION_METHOD = "groq_llm"
PROFILE_VERSION = "2.0"
EXTRA_CALLS = 2

# Words that mark a policy field: fixed values.
POLICY_WORDS = ["policy", "warranty", "refund", "terms"]

# Declared ranges of fields by record, as (field, least, greatest, least excluded): fixed values.
FIELD_RANGES = {
    "file": [("file_size", 0, None, True)],
    "page": [("page_number", 1, None, False)],
    "table": [("confidence", 0, 1, False)],
    "analysis": [("confidence", 0, 1, False)],
    "posting": [("relevance_score", 0, 1, False)],
    "business": [("average_rating", 0, 5, False)],
    "extraction": [("confidence_score", 0, 1, False)],
    "pricing": [("base_price", 0, None, False), ("discount_price", 0, None, False)],
    "scores": [("completeness_score", 0, 1, False)],
    "job": [("progress", 0, 100, False)],
}
