"""Values that decide results: patterns, word lists, limits and message texts."""

# ---------------------------------------------------------------------------
# FIXED VALUES. Results depend on every entry and on the order of entries.
# ---------------------------------------------------------------------------

# White space as Python's str methods see it: tab to carriage return, the four
# separators, space, next line, no-break space and the Unicode spaces.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# E-mail
EMAIL_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
EMAIL_HOST = r"[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
SIMPLE_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DOMAIN_NAME = r"^([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"
MAILTO = r"""href="mailto:([^"'\?]+)"""
MAILTO_CONTEXT = "Extracted from mailto link"
JUNK_DOMAINS = [
    "example.com", "test.com", "domain.com", "email.com",
    "yourdomain.com", "site.com", "company.com",
]
JUNK_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "css", "js", "svg", "woff", "ttf", "eot",
    "mp4", "mp3", "wav", "pdf", "zip", "rar", "exe", "iso",
]
FREE_MAIL_WORDS = ["gmail", "yahoo", "hotmail"]
FREE_MAIL_PENALTY = 0.3
SHORT_NAME_PENALTY = 0.1
SHORT_NAME_LENGTH = 3
CONTEXT_CHARS = 30
REPORT_CONTEXT_CHARS = 100

# Phone: digits and spaces stand for their Unicode classes
PHONE_PARTS = r"(?:\+?{d}{{1,3}}[-.{s}]?)?(?:\(?{d}{{2,4}}\)?[-.{s}]?)?{d}{{3,4}}[-.{s}]?{d}{{3,4}}"
PHONE_DIGITS = (8, 15)

# Social profiles: host pattern -> network
SOCIAL_URL = (
    r"(?:https?://)?(?:www\.)?"
    r"(facebook\.com|twitter\.com|x\.com|instagram\.com|linkedin\.com|wa\.me)"
    r"/[A-Za-z0-9_.-]+"
)
SOCIAL_HOSTS = {
    "facebook": ["facebook.com"],
    "instagram": ["instagram.com"],
    "linkedin": ["linkedin.com"],
    "twitter": ["twitter.com", "x.com"],
    "whatsapp": ["wa.me"],
}

# URLs in text
URL_LABEL = r"[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]"
URL_TRIM = ".,;:\"'()[]{}<>"
URL_SKIPPED_ENDINGS = [".pdf", ".jpg", ".png", ".gif", ".zip", ".exe", ".css", ".js"]

# HTML
CONTENT_TAGS = [
    "script", "style", "noscript", "iframe", "embed",
    "object", "applet", "audio", "video", "canvas",
    "svg", "math",
]
NAV_TAGS = ["nav", "header", "footer", "aside", "menu"]
# Elements that never have content
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "meta", "param", "source", "track", "wbr",
]
SKIPPED_LINK_STARTS = ["#", "javascript:", "mailto:"]
MIN_TEXT_LENGTH = 10
MIN_WORDS = 10

# Role categories of an address, in tie order
ROLE_KEYWORDS = {
    "sales": ["sales", "pricing", "quote", "purchase", "buy", "order", "commerce", "shop",
              "store", "deals", "offer"],
    "support": ["support", "help", "service", "assist", "ticket", "helpdesk", "customer", "care"],
    "marketing": ["marketing", "newsletter", "promo", "campaign", "advertise", "media", "pr",
                  "communications", "brand"],
    "hr": ["hr", "human resources", "recruitment", "careers", "jobs", "hiring", "talent",
           "recruiting"],
    "tech": ["tech", "it", "development", "engineering", "developer", "software", "devops",
             "sysadmin", "infrastructure"],
    "finance": ["finance", "accounting", "billing", "payment", "invoice", "accounts", "payable",
                "receivable", "treasury"],
    "legal": ["legal", "compliance", "privacy", "gdpr", "terms", "lawyer", "attorney", "counsel"],
    "executive": ["ceo", "cto", "cfo", "coo", "executive", "president", "director", "vp",
                  "vice president", "chief"],
    "general": ["info", "contact", "general", "inquiry", "hello"],
}
ROLE_PATTERNS = {
    "sales": ["sales@", "shop@", "order@", "commerce@"],
    "support": ["support@", "help@", "service@", "care@"],
    "marketing": ["marketing@", "newsletter@", "promo@", "media@"],
    "hr": ["hr@", "careers@", "jobs@", "recruiting@", "talent@"],
    "tech": ["tech@", "it@", "dev@", "engineering@"],
    "finance": ["finance@", "billing@", "accounting@", "ar@", "ap@"],
    "legal": ["legal@", "compliance@", "privacy@", "counsel@"],
    "executive": ["ceo@", "cto@", "cfo@", "president@"],
    "general": ["info@", "contact@", "hello@", "general@"],
}
ROLE_PATTERN_WEIGHT = 0.8
ROLE_NAME_WEIGHT = 0.3
ROLE_CONTEXT_WEIGHT = 0.1
CATEGORY_THRESHOLD = 0.5
ROLE_PERSON = {
    "sales": "Sales representative",
    "support": "Customer support representative",
    "marketing": "Marketing professional",
    "hr": "HR/Recruitment specialist",
    "tech": "Technical contact",
    "finance": "Finance/Accounting contact",
    "legal": "Legal/Compliance officer",
    "executive": "Executive/Leadership",
    "general": "General inquiry contact",
}
DEFAULT_PERSON = "General contact"

# Site types of a domain, in tie order
SITE_KEYWORDS = {
    "ecommerce": ["shop", "store", "cart", "buy", "marketplace", "retail"],
    "saas": ["app", "platform", "cloud", "software", "service", "tool"],
    "agency": ["agency", "studio", "creative", "design", "marketing", "digital"],
    "consulting": ["consulting", "advisory", "solutions", "partners", "group"],
    "education": ["edu", "university", "school", "academy", "learning", "training"],
    "nonprofit": ["org", "foundation", "charity", "nonprofit", "ngo"],
    "government": ["gov", "government", "municipal", "state", "federal"],
}
SITE_DOMAIN_WEIGHT = 0.5
SITE_TEXT_WEIGHT = 0.1
SITE_TEXT_CAP = 0.5
SITE_TEXT_CHARS = 5000

# Business labels of a page text, in tie order
BUSINESS_KEYWORDS = {
    "bakery": ["bakery", "baker", "pastry", "cake", "bread", "croissant", "cookies", "baking",
               "patisserie"],
    "hotel": ["hotel", "motel", "resort", "inn", "hostel", "suites", "accommodation", "booking",
              "rooms"],
    "clothing": ["clothing", "apparel", "boutique", "fashion", "garment", "dresses", "menswear",
                 "womenswear", "shirts"],
    "restaurant": ["restaurant", "cafe", "diner", "menu", "food", "dining", "kitchen", "eatery",
                   "bistro"],
    "real_estate": ["real estate", "realtor", "property", "properties", "apartments", "housing",
                    "mortgage", "broker", "listings"],
    "tech": ["software", "technology", "tech", "app", "platform", "cloud", "saas", "development",
             "it services"],
    "medical": ["clinic", "hospital", "medical", "doctor", "patient", "health", "healthcare",
                "care", "treatment"],
    "fitness": ["gym", "fitness", "workout", "training", "yoga", "pilates", "health club",
                "exercise"],
    "manufacturing": ["manufacturing", "industrial", "steel plant", "factory", "production",
                      "machinery", "assembly", "plant"],
    "corporate": ["corporate", "enterprise", "holdings", "group", "corporation", "inc", "llc"],
    "ecommerce": ["e-commerce", "ecommerce", "online store", "cart", "checkout"],
}
HEAVY_BUSINESS = ["manufacturing", "corporate", "ecommerce"]
HEAVY_WEIGHT = 3
UNKNOWN_BUSINESS = "unknown"

# Crawl walk and budgets
WALK_MAX_PAGES = 15
WALK_MAX_EMAILS = 5
DEEP_MODE = "deep"
MODES = ["quick", "deep", "custom"]
OUTPUT_FORMATS = ["csv", "xlsx", "json"]
NO_URLS_ERROR = "No valid URLs found in input data."
NO_CONTACTS_ERROR = "No contacts could be extracted from the provided URLs."
MAX_PAGE_BYTES = 10 * 1024 * 1024
BYTES_PER_MB = 1024 * 1024
# Reason of a block set by hand; a log gives none
MANUAL_BLOCK = "Manual block"

# Encryption
KEY_BYTES = 32
SALT_BYTES = 16
IV_BYTES = 12
TAG_BYTES = 16
KEY_ROUNDS = 100000
