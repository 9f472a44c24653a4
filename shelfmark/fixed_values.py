"""Values that results must equal exactly. Plain data, no logic."""

# Defaults shown to readers.
DEFAULT_CURRENCY = "ETB"
DEFAULT_EMOJI = "🍽"
ALL_TAB = ("all", "🔥 All")
NO_CATEGORY_LABEL = "No category"
NO_CATEGORY_ORDER = 999
SEPARATOR = " • "
ADDRESS_PIN = "📍 "
PHONE_PIN = "📞 "
TITLE_SUFFIX = " Menu"
TITLE_SUFFIX_AM = " ሜኑ"

# Labels for item state.
SOLD_OUT = "SOLD OUT"
BADGE_LABELS = {"new": "NEW", "hot": "HOT"}

# Column defaults of the stored tables.
CATEGORY_DEFAULTS = {"emoji": "🍽", "icon_bg": "#f4f1e9", "sort_order": 0, "is_active": True}
ITEM_DEFAULTS = {"price": 0, "emoji": "🍽", "is_available": True, "sort_order": 0}

# Icon background by category slug.
SLUG_COLOURS = {
    "pizza": "#fff3e0",
    "burger": "#fce4ec",
    "juice": "#e8f5e9",
    "coffee": "#efebe9",
    "breakfast": "#fff8e1",
    "main": "#f3e5f5",
    "fastfood": "#e3f2fd",
}

# Limits.
SNAPSHOT_TTL_MS = 7 * 24 * 60 * 60 * 1000
MAX_IMAGE_BYTES = 2 * 1024 * 1024

# HTML entities.
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]

# Media type by file extension.
MEDIA_TYPES = {
    ".html": "text/html; charset=utf-8",
    ".js": "text/javascript; charset=utf-8",
    ".css": "text/css; charset=utf-8",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".svg": "image/svg+xml",
    ".json": "application/json",
    ".ico": "image/x-icon",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# White space as ECMAScript trims it, as characters and as a regex class (Java and RE2).
JS_SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) \
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_SPACE = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# Patterns.
SLUG_PATTERN = r"\A[a-z0-9-]+\z"
IMAGE_TYPE_PATTERN = r"\Aimage/"
SCRIPT_BLOCKS = r"<script[^>]*>[\s\S]*?</script>"
EXTERNAL_SCRIPTS = r"<script[^>]*src=[^>]*></script>"
FONT_LINKS = r'<link[^>]*href="https://fonts[^>]*>'
BLOCK_COMMENTS = r"/\*[\s\S]*?\*/"
LINE_COMMENTS = r"//[^\n\r\x{2028}\x{2029}]*"

# Secret rules (name, pattern, whether comments are removed before matching).
SECRET_RULES = [
    ("service_key_word", r"(?i)service_role|SUPABASE_SERVICE", True),
    ("service_key_assigned", r"(?i)service_role[\"']?\s*[:=]|SERVICE_ROLE_KEY\s*[:=]", True),
    ("service_key_assigned_raw", r"(?i)service_role[\"']?\s*[:=]|SERVICE_ROLE_KEY\s*[:=]", False),
    ("signed_token_header", r"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", False),
]

# Message rules (label, patterns that must all match), first match wins.
WRITE_MESSAGE_RULES = [
    ("bad_credentials", [r"(?i)Invalid login credentials"]),
    ("unconfirmed", [r"(?i)Email not confirmed"]),
    ("denied", [r"(?i)row-level security|permission denied|violates row-level"]),
    ("duplicate_slug", [r"(?i)duplicate key", r"(?i)slug"]),
    ("network", [r"(?i)Failed to fetch|NetworkError"]),
]
PROBE_MESSAGE_RULES = [
    ("tables_missing", [r"(?i)relation .* does not exist|schema cache"]),
    ("key_rejected", [r"(?i)Invalid API key|JWT"]),
]

# Token roles.
PUBLIC_ROLE = "anon"
FORBIDDEN_ROLE = "service_role"

# Access rules. Owners may do these; nobody may do anything else.
OWNER_WRITES = {
    "menu_items": ["insert", "update", "delete"],
    "categories": ["insert", "update", "delete"],
    "cafe_info": ["insert", "update"],
    "objects": ["insert", "update", "delete"],
}
GUARDED_TABLES = ["menu_items", "categories", "cafe_info", "admin_users", "objects"]
WRITE_OPS = ["insert", "update", "delete"]
VIEWER_ROLES = ["anon", "member", "owner"]
OBJECT_BUCKET = "menu-images"
