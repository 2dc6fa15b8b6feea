"""Fixed values the results depend on. They are matched exactly and must not be edited, but where marked as our own."""

from __future__ import annotations

# Asset categories by lower-cased path suffix.
ASSET_CATEGORIES = {
    "html": [".html", ".htm"],
    "css": [".css"],
    "js": [".js", ".mjs", ".ts"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".avif"],
    "font": [".woff2", ".woff", ".ttf", ".eot", ".otf"],
    "media": [".mp4", ".webm", ".mp3", ".wav", ".ogg", ".mov"],
    "doc": [".pdf", ".txt", ".xml", ".json"],
}

# Category by content-type fragment, first hit wins.
CATEGORY_BY_CONTENT_TYPE = [
    ("text/css", "css"),
    ("javascript", "js"),
    ("image/", "image"),
    ("font/", "font"),
    ("audio/", "media"),
    ("video/", "media"),
]

# Suffixes kept as they are in a URL path.
KEPT_EXTENSIONS = [
    ".html", ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff",
    ".woff2", ".ttf", ".eot",
]

# Extension by content-type fragment, first hit wins.
EXTENSION_BY_CONTENT_TYPE = [
    ("text/html", ".html"),
    ("text/css", ".css"),
    ("application/javascript", ".js"),
    ("text/javascript", ".js"),
    ("image/png", ".png"),
    ("image/jpeg", ".jpg"),
    ("image/gif", ".gif"),
    ("image/svg+xml", ".svg"),
    ("image/webp", ".webp"),
    ("image/x-icon", ".ico"),
    ("font/woff", ".woff"),
    ("font/woff2", ".woff2"),
]

# Embedded font types by path suffix.
FONT_MIME = {
    ".woff2": "font/woff2",
    ".woff": "font/woff",
    ".ttf": "font/ttf",
    ".eot": "application/vnd.ms-fontobject",
}

# Scanner patterns (Java and RE2 read them alike).
SECRET_PATTERNS = {
    "aws_key": r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
    "google_api": r"AIza[0-9A-Za-z\\-_]{35}",
    "slack_token": r"xox[baprs]-([0-9a-zA-Z]{10,48})",
    "private_key": r"-----BEGIN [A-Z ]+ PRIVATE KEY-----",
    "generic_secret": (
        r"(?i)(api[_-]?key|auth|secret|token|password|pwd)[\s=:\"\']{0,5}[a-zA-Z0-9\-_]{20,}"
    ),
}
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Fragments that mark an e-mail hit as an image name.
EMAIL_NOISE = [".png", ".jpg", ".gif", ".svg", ".webp"]

# Fragments that mark a script or style comment as boilerplate. The last one is
# compared with lower-cased text, so it never applies; kept because results depend on it.
COMMENT_NOISE = ["copyright", "license", "webpack", "sourceMappingURL"]

# Link prefixes that are not crawled.
UNCRAWLED_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

# url(...) and @import references in style text.
CSS_URL_PATTERN = r"""url\(["']?([^"')\s]+)["']?\)"""
CSS_IMPORT_PATTERN = r"""@import\s+["']([^"']+)["']"""

# Fixed value: marker of the image-resizing endpoint.
IMAGE_PROXY = "/_next/image"

# Our own, shorter form, not matched to anything: style rules appended to a rewritten page so that
# script-driven elements show. Kept here as results depend on it.
REVEAL_STYLE = (
    '<style>[style*="opacity"] { opacity: 1 !important; } '
    ".transform-gpu { transform: scale(1) !important; } "
    "[data-nimg] { opacity: 1 !important; }</style>"
)

# Fixed value: the white space cut off both ends of comments and snippets.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
