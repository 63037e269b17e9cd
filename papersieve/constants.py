"""Word lists, lookup tables and thresholds that results depend on.

Everything in this module is data. The values are stated in full because the
scores only agree with the published calibration when they are identical.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
PDF_HEADER = "%PDF-"
PDF_EOF = "%%EOF"
HEADER_SEARCH_BYTES = 1024
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_OBJECTS = 20_000
MAX_SCRIPT_CHARS = 200_000
MAX_URLS = 500
MAX_URLS_PER_SCRIPT = 50
MAX_TEXT_EXCERPT_CHARS = 4000
MAX_TEXT_PAGES = 5
EMBEDDED_SAMPLE_BYTES = 4096
MAX_PAGES_WALKED = 512
MAX_ANNOTS_PER_PAGE = 512

# Keywords counted as substrings of the name-decoded bytes, in report order.
PDF_KEYWORDS = (
    "obj", "endobj", "stream", "endstream", "xref", "trailer", "startxref",
    "/Page", "/Encrypt", "/ObjStm", "/JS", "/JavaScript", "/AA", "/OpenAction",
    "/AcroForm", "/JBIG2Decode", "/RichMedia", "/Launch", "/EmbeddedFile",
    "/XFA", "/URI", "/SubmitForm", "/GoToR", "/GoToE", "/Colors", "/Filter",
    "/FlateDecode", "/ASCIIHexDecode", "/ASCII85Decode", "/LZWDecode",
    "/RunLengthDecode", "/DCTDecode", "/CCITTFaxDecode", "/Crypt", "/Sound",
    "/Movie", "/Annots", "/FileAttachment", "/ObjRef",
)

STREAM_FILTERS = (
    "FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "LZWDecode",
    "RunLengthDecode", "DCTDecode", "CCITTFaxDecode", "JBIG2Decode",
    "JPXDecode", "Crypt",
)

JS_SUSPICIOUS_TOKENS = (
    "eval", "unescape", "decodeURI", "decodeURIComponent",
    "String.fromCharCode", "fromCharCode", "app.launchURL", "app.alert",
    "app.setTimeOut", "app.execMenuItem", "this.exportDataObject",
    "this.importDataObject", "this.submitForm", "this.getAnnots",
    "this.getURL", "util.printf", "util.byteToChar",
    "Collab.collectEmailInfo", "Collab.getIcon", "media.newPlayer",
    "spell.customDictionaryOpen", "getIcon", "escape(", "ActiveXObject",
    "WScript", "Shell.Application", "cmd.exe", "powershell",
    "XMLHttpRequest", "atob", "btoa", "arguments.callee", "heapLib",
    "sprayHeap", "%u9090", "\\x90\\x90", "shellcode",
)

JS_CRITICAL_TOKENS = (
    "util.printf", "Collab.collectEmailInfo", "Collab.getIcon",
    "media.newPlayer", "spell.customDictionaryOpen", "heapLib", "sprayHeap",
    "%u9090", "shellcode", "powershell", "cmd.exe", "ActiveXObject", "WScript",
)

JS_CVE_HINTS = (
    ("util.printf", "CVE-2008-2992"),
    ("Collab.collectEmailInfo", "CVE-2007-5659"),
    ("Collab.getIcon", "CVE-2009-0927"),
    ("media.newPlayer", "CVE-2009-4324"),
    ("spell.customDictionaryOpen", "CVE-2009-1493"),
    ("getAnnots", "CVE-2009-1492"),
)

EXECUTABLE_EXTENSIONS = (
    ".exe", ".dll", ".scr", ".com", ".pif", ".cpl", ".msi", ".msp", ".jar",
    ".bat", ".cmd", ".ps1", ".psm1", ".vbs", ".vbe", ".js", ".jse", ".wsf",
    ".wsh", ".hta", ".lnk", ".reg", ".sh", ".elf", ".app", ".apk", ".iso",
    ".img", ".vhd", ".chm", ".sys", ".scf", ".inf",
)
EXECUTABLE_MAGIC = ("dos/pe-executable", "elf-executable", "mach-o", "mach-o-64")
ARCHIVE_EXTENSIONS = (
    ".zip", ".rar", ".7z", ".cab", ".ace", ".gz", ".bz2", ".xz", ".tar", ".lzh",
)
OFFICE_MACRO_EXTENSIONS = (
    ".docm", ".xlsm", ".pptm", ".dotm", ".xltm", ".xlam", ".doc", ".xls",
    ".ppt", ".rtf",
)
EXPECTED_MAGIC = (
    (".pdf", "pdf"), (".zip", "zip-container"), (".docx", "zip-container"),
    (".xlsx", "zip-container"), (".gz", "gzip"), (".rar", "rar-archive"),
    (".7z", "7z-archive"),
)

# Leading bytes as hex, first match wins.
MAGIC_SIGNATURES = (
    ("4D5A", "dos/pe-executable"),
    ("7F454C46", "elf-executable"),
    ("CAFEBABE", "mach-o/java-class"),
    ("FEEDFACE", "mach-o"),
    ("FEEDFACF", "mach-o-64"),
    ("504B0304", "zip-container"),
    ("526172211A07", "rar-archive"),
    ("377ABCAF271C", "7z-archive"),
    ("D0CF11E0", "ole2-compound"),
    ("7B5C727466", "rtf-document"),
    ("23212F", "script-shebang"),
    ("255044462D", "pdf"),
    ("1F8B", "gzip"),
    ("49545346", "chm-help"),
    ("4D534346", "cab-archive"),
)

URL_SHORTENER_HOSTS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "cutt.ly", "rebrand.ly", "shorturl.at", "rb.gy", "tiny.cc", "bl.ink",
    "s.id", "t.ly", "shorte.st", "adf.ly", "bc.vc", "clck.ru", "v.gd",
)
SUSPICIOUS_TLDS = (
    ".zip", ".mov", ".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz",
    ".click", ".link", ".work", ".loan", ".download", ".stream", ".review",
    ".country", ".kim", ".science", ".party", ".gdn", ".men", ".date",
)
DANGEROUS_URI_SCHEMES = (
    "file", "javascript", "data", "smb", "ftp", "telnet", "vbscript",
    "ms-msdt", "search-ms",
)
SWEPT_URI_SCHEMES = (
    "http", "https", "ftp", "file", "smb", "javascript", "data", "vbscript",
    "ms-msdt", "search-ms",
)

# Additional-action keys and the trigger each one names.
AA_TRIGGERS = (
    ("/O", "PageOpen"), ("/C", "PageClose"), ("/WC", "WillClose"),
    ("/WS", "WillSave"), ("/DS", "DidSave"), ("/WP", "WillPrint"),
    ("/DP", "DidPrint"), ("/E", "MouseEnter"), ("/X", "MouseExit"),
    ("/D", "MouseDown"), ("/U", "MouseUp"), ("/Fo", "Focus"), ("/Bl", "Blur"),
    ("/K", "Keystroke"), ("/F", "Format"), ("/V", "Validate"),
    ("/Cc", "Calculate"),
)
AA_AUTO_TRIGGERS = ("PageOpen", "PageClose", "WillClose", "DocumentOpen")
ACTION_KINDS = (
    "/Launch", "/URI", "/SubmitForm", "/GoToR", "/GoToE", "/Movie", "/Sound",
    "/Rendition",
)
RICH_MEDIA_SUBTYPES = ("/RichMedia", "/Screen", "/Movie", "/Sound", "/3D")
INFO_FIELDS = (
    ("/Title", "title"), ("/Author", "author"), ("/Subject", "subject"),
    ("/Keywords", "keywords"), ("/Creator", "creator"),
    ("/Producer", "producer"), ("/CreationDate", "creation_date"),
    ("/ModDate", "modification_date"),
)

# Orders: position is rank. "unknown" sits between low_risk and suspicious.
SEVERITY_ORDER = ("info", "low", "medium", "high", "critical")
VERDICT_ORDER = ("clean", "low_risk", "unknown", "suspicious", "malicious")
NON_TERMINAL_STATUSES = ("pending", "analyzing", "ai_review")
FINISHED_STATUSES = ("completed", "quarantined")

# Score bands and calibration limits.
MALICIOUS_AT = 80
SUSPICIOUS_AT = 50
LOW_RISK_AT = 20
CRITICAL_FLOOR = 75
HIGH_FLOOR = 45
SOLE_INDICATOR_CEILING = 79
NAME_ESCAPES_MIN = 5
MINIMAL_TEXT_CHARS = 200
HIGH_ENTROPY = 7.5
JS_HIGH_ENTROPY = 5.2
LONG_JS_LINE = 1000
MANY_UPDATES = 3
LARGE_TRAILING_BYTES = 1024
OBFUSCATED_AT = 0.45
HEAVILY_OBFUSCATED_AT = 0.7
SEVERITY_WEIGHTS = (
    ("critical", 85), ("high", 60), ("medium", 35), ("low", 20), ("info", 5),
)

# Second-opinion gate and fusion.
GATE_MIN = 25
GATE_MAX = 85
THIN_EVIDENCE_MAX = 3
AI_SCORE_WEIGHT = 0.6
VERDICT_BANDS = (
    ("clean", 0, 19), ("low_risk", 20, 49), ("suspicious", 50, 79),
    ("malicious", 80, 100),
)
VERDICT_ALIASES = (
    ("benign", "clean"), ("safe", "clean"), ("no_threat", "clean"),
    ("low", "low_risk"), ("lowrisk", "low_risk"), ("medium", "suspicious"),
    ("potentially_malicious", "suspicious"), ("high", "malicious"),
    ("malware", "malicious"), ("inconclusive", "unknown"),
)
RECOMMENDED_ACTIONS = ("allow", "review", "quarantine", "block")
FALSE_POSITIVE_RISKS = ("low", "medium", "high")
RETRYABLE_STATUS = (408, 409, 425, 429, 500, 502, 503, 504, 529)
QUOTA_PHRASES = (
    "exceeded your current quota", "quota_exceeded", "insufficient_quota",
    "quota exceeded", "billing details",
)
RATE_PHRASES = ("per minute", "tokens per minute", "tpm")
CHARS_PER_TOKEN = 3.6
EVIDENCE_MAX_CHARS = 24_000
EVIDENCE_LIMITS = (
    ("indicators", 25), ("actions", 20), ("attachments", 15), ("urls", 25),
    ("signatures", 20), ("scripts", 6), ("parse_errors", 5),
)
MIN_SCRIPT_CHARS = 400
EXCERPT_CHARS = 2000
COMPACT_CHARS = 2000
SHRINK_ITEMS = 5
SHRINK_CHARS = 600

# Evaluation.
THRESHOLDS = (10, 20, 25, 35, 40, 50, 80)
PRODUCT_BANDS = (20, 50, 80)
ESCAPE_CUTOFFS = (1, 2, 3, 5, 10, 20, 50)
PARSE_ONLY_CODES = ("PDF_PARSE_FAILURE",)
THIN_LIMITS = (1, 2, 3, 4)
PLAN_TOKENS_IN = 3000
PLAN_TOKENS_OUT = 500
USD_PER_MILLION_IN = 3.0
USD_PER_MILLION_OUT = 15.0
SAMPLE_SHARES = (
    ("false positives at >= 80", 0.25),
    ("thin evidence at >= 80 (malware)", 0.20),
    ("true positives 90-100", 0.20),
    ("true positives 80-89", 0.15),
    ("true positives 50-79", 0.10),
    ("true negatives 20-79", 0.10),
)
ABORT_AFTER_FAILURES = 5
SCORE_EDGES = tuple(range(0, 101, 10))
DURATION_EDGES = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60)
LATENCY_EDGES = (0.5, 1, 2, 5, 10, 20, 40, 60)

# History and folder watching.
RECENT_LIMIT = 200
KEEP_SCANS = 5000
STALE_HOURS = 2
USAGE_RETENTION_DAYS = 7
PARTIAL_SUFFIXES = (
    ".crdownload", ".part", ".partial", ".tmp", ".download", ".opdownload",
    ".!ut",
)
STABLE_CHECKS = 2
SETTLE_TIMEOUT_SECONDS = 120
COLUMN_CAPS = (
    ("filename", 512), ("summary", 4000), ("text_excerpt", 8000),
    ("code", 64), ("title", 255), ("category", 64), ("error_code", 64),
    ("error_message", 4000), ("event_message", 1000),
)
