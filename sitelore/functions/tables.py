"""Word lists, weights, hosts and formats that results depend on."""

from typing import NamedTuple

# Query parameters that only track visitors.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
TRACKING_PREFIX = "utm_"
# Link schemes that lead to no page.
OTHER_SCHEMES = ("mailto", "tel", "javascript", "data", "file", "ftp")
# Labels that make a public suffix together with a country's two letters, and general suffixes. Each country's own two letters are a suffix by rule;
# hosts under any other name keep their host.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gub", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
GENERAL_SUFFIXES = ("agency", "app", "art", "biz", "blog", "business", "cafe", "capital", "care", "cat", "center", "church", "city", "cloud", "club", "coach", "coffee", "community", "company", "consulting", "com", "coop", "design", "dental", "dev", "digital", "edu", "education", "email", "energy", "engineering", "estate", "events", "expert", "farm", "finance", "fit", "fitness", "foundation", "fund", "fyi", "gallery", "global", "gov", "group", "guide", "health", "house", "info", "ink", "institute", "int", "international", "jobs", "kitchen", "land", "law", "legal", "life", "link", "live", "london", "ltd", "management", "market", "marketing", "media", "mil", "mobi", "museum", "name", "net", "network", "news", "ngo", "online", "org", "page", "partners", "photography", "pizza", "plumbing", "plus", "pro", "properties", "pub", "realty", "rentals", "repair", "restaurant", "school", "services", "shop", "site", "software", "solutions", "space", "store", "studio", "support", "systems", "team", "tech", "technology", "top", "tours", "town", "toys", "training", "travel", "university", "vet", "video", "vip", "website", "wiki", "work", "works", "world", "xyz", "yoga", "zone")
TWO_LABELS = rf"(?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}"
ONE_LABEL = rf"(?:[a-z]{{2}}|xn--[a-z0-9-]+|{'|'.join(GENERAL_SUFFIXES)})"

# First words of shared mailboxes.
GENERIC_PREFIXES = ("admin", "billing", "bookings", "business", "care", "commercial", "contact", "customerservice", "enquiries", "enquiry", "export", "feedback", "hello", "help", "hr", "info", "inquiry", "jobs", "legal", "mail", "marketing", "media", "office", "orders", "press", "privacy", "reception", "recruiting", "reservations", "returns", "sales", "service", "support", "team", "webmaster")
# Free mail hosts.
FREE_MAIL = ("aol.com", "gmail.com", "hotmail.com", "icloud.com", "live.com", "mail.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.com", "ymail.com")
# Parts and endings of strings that only look like addresses.
BAD_EMAIL_PARTS = ("example.com", "domain.com", "email.com", "sentry.io", "sentry.wixpress.com", "test.com", "wixpress.com")
BAD_EMAIL_ENDINGS = (".avif", ".css", ".gif", ".jpeg", ".jpg", ".js", ".png", ".svg", ".webp")
# Confidence of an e-mail, phone and social evidence by its source.
EMAIL_SOURCES = {"mailto": 0.98, "json_ld": 0.96, "cloudflare": 0.95, "visible_text": 0.88, "html": 0.72, "obfuscated": 0.86}
PHONE_SOURCES = {"tel": 0.99, "json_ld": 0.96, "visible_text": 0.80}
SOCIAL_SOURCES = {"anchor": 0.94, "json_ld": 0.98}
# Patterns of addresses and numbers.
EMAIL_PATTERN = r"(?<![\w.+-])([A-Z0-9._%+\-]{1,64}@[A-Z0-9.\-]{1,253}\.[A-Z]{2,24})(?![\w.-])"
OBFUSCATED_PATTERN = r"([A-Z0-9._%+\-]{1,64})\s*(?:\[|\(|\{)?\s*(?:at|@)\s*(?:\]|\)|\})?\s*([A-Z0-9\-]+(?:\s*(?:\[|\(|\{)?\s*(?:dot|\.)\s*(?:\]|\)|\})?\s*[A-Z0-9\-]+)+)"
PHONE_PATTERN = r"(?<!\w)(?:\+\d{1,3}[\s().-]*)?(?:\(?\d{2,4}\)?[\s().-]*)\d{2,4}[\s().-]*\d{3,5}(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?(?!\w)"

# Hosts of social platforms, the canonical host, and parts of paths that are no profile.
SOCIAL_HOSTS = {"facebook": ("facebook.com", "fb.com"), "instagram": ("instagram.com",), "linkedin": ("linkedin.com",), "pinterest": ("pinterest.com",), "threads": ("threads.net",), "tiktok": ("tiktok.com",), "twitter": ("twitter.com", "x.com"), "youtube": ("youtube.com", "youtu.be")}
SOCIAL_CANONICAL = {"facebook": "facebook.com", "instagram": "instagram.com", "linkedin": "linkedin.com", "pinterest": "pinterest.com", "threads": "threads.net", "tiktok": "tiktok.com", "twitter": "x.com", "youtube": "youtube.com"}
SOCIAL_REJECT = ("/dialog/", "/help", "/home", "/intent/", "/login", "/oauth", "/privacy", "/search", "/share", "/sharer", "/signup", "/status/", "/terms")
# First parts of paths whose second part is the profile.
SOCIAL_TWO_PARTS = {"linkedin": ("company", "in", "school", "showcase"), "youtube": ("channel", "c", "user")}
SOCIAL_FIRST_REJECT = {
    "facebook": ("events", "groups", "marketplace", "photo", "photos", "posts", "reel", "reels", "videos", "watch", "profile.php"),
    "instagram": ("about", "accounts", "developer", "explore", "p", "reel", "reels", "search", "stories"),
    "twitter": ("about", "accounts", "developer", "explore", "hashtag", "home", "i", "intent", "legal", "search", "share"),
    "threads": ("about", "accounts", "discover", "explore", "legal", "privacy", "search", "terms"),
    "pinterest": ("ideas", "pin", "search"),
}
# Result column of each platform.
SOCIAL_COLUMNS = {"facebook": "facebook", "instagram": "instagram", "linkedin": "linkedin", "twitter_x": "twitter", "youtube": "youtube", "tiktok": "tiktok", "pinterest": "pinterest", "threads": "threads"}

# Statuses and markers of blocked, parked and script-only pages.
TRANSIENT_STATUSES = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)
BLOCK_STATUSES = (401, 403, 407, 418, 429, 451, 503)
BLOCK_MARKERS = ("access denied", "attention required", "bot detection", "captcha", "cf-chl-", "checking your browser", "cloudflare ray id", "enable javascript and cookies", "incapsula", "perimeterx", "press and hold", "request blocked", "security check", "unusual traffic", "verify you are human")
ROOT_MARKERS = ('id="root"', "id='root'", 'id="app"', "id='app'", "__next_data__")
PARKED_MARKERS = ("buy this domain", "domain for sale", "for sale", "coming soon", "under construction", "parkingcrew", "sedo", "hugedomains", "dan.com", "undeveloped")

# Weights of words in links, by what is wanted.
RANK_BASE = {"contact": 70, "contact-us": 70, "about": 55, "about-us": 60, "support": 45, "help": 35, "team": 35, "company": 35, "location": 35, "locations": 35, "leadership": 30, "staff": 25, "people": 20, "privacy": 12, "legal": 12}
RANK_CONTACT = {"contact": 220, "contact-us": 220, "support": 90, "help": 65, "location": 110, "locations": 110, "office": 75}
RANK_DESCRIPTION = {"about": 190, "about-us": 200, "company": 130, "our-story": 120, "who-we-are": 120, "mission": 80, "team": 65, "leadership": 55}
RANK_SOCIAL_LEAST = {"contact": 120, "about": 90, "team": 75}
RANK_SOCIAL = {"community": 70, "connect": 100}
RANK_NEGATIVE = ("blog", "cart", "category", "checkout", "login", "news", "product", "shop", "signup", "tag")
GUESSED_CONTACT = {"/contact": 180, "/contact-us": 179, "/support": 70}
GUESSED_ABOUT = {"/about": 150, "/about-us": 149, "/company": 100, "/team": 80}
GUESSED_OTHER = {"/contact": 90, "/about": 60}

# Words of descriptions.
DESCRIPTION_BAD = ("cookie", "all rights reserved", "privacy policy")
DESCRIPTION_GOOD = ("we are", "founded", "established", "specialize", "our company", "our mission")

# Hosts of business directories, legal forms, hosts that searches leave out, suffixes by place.
DIRECTORY_HOSTS = ("angi.com", "bbb.org", "bloomberg.com", "chamberofcommerce.com", "clutch.co", "crunchbase.com", "datanyze.com", "dnb.com", "facebook.com", "find-and-update.company-information.service.gov.uk", "glassdoor.com", "google.com", "hotfrog.com", "instagram.com", "linkedin.com", "manta.com", "opencorporates.com", "rocketreach.co", "signalhire.com", "theorg.com", "thumbtack.com", "x.com", "yelp.com", "youtube.com", "zoominfo.com")
LEGAL_SUFFIXES = ("co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "llc", "llp", "ltd", "limited", "lp", "plc", "pvt", "sa", "services", "the")
SEARCH_EXCLUDED = ("bbb.org", "bloomberg.com", "chamberofcommerce.com", "crunchbase.com", "facebook.com", "instagram.com", "linkedin.com", "manta.com", "opencorporates.com", "yelp.com", "zoominfo.com")
GUESS_SUFFIXES = ("com", "net", "org", "co")
PLACE_SUFFIXES = {"australia": ("com.au", "net.au", "au"), "australian": ("com.au", "net.au", "au"), "au": ("com.au", "net.au", "au"), "nsw": ("com.au", "net.au", "au"), "vic": ("com.au", "net.au", "au"), "qld": ("com.au", "net.au", "au"), "usa": ("com", "us"), "united states": ("com", "us"), "us": ("com", "us"), "india": ("in", "co.in"), "in": ("in", "co.in"), "korea": ("kr", "co.kr"), "south korea": ("kr", "co.kr"), "kr": ("kr", "co.kr")}
# Least score of a candidate by its source.
SOURCE_FLOORS = {"wikidata": 0.25, "clearbit": 0.12, "google_cse": 0.16, "brave": 0.16, "serpapi": 0.16, "searchapi": 0.16, "searxng": 0.16}



class Provider(NamedTuple):
    """Score of a provider's hit: ``base`` less ``step`` for each position before it, ``least`` at least, and ``alike`` times the likeness of its title to the company. The first ``most`` hits are read."""

    base: float
    alike: float = 0.0
    step: float = 0.0
    least: float = 0.0
    most: int = 1_000_000


# Providers in the order in which equal hits are taken.
PROVIDERS = {
    "clearbit": Provider(0.10, alike=0.12, most=8),
    "wikidata": Provider(0.24, alike=0.15),
    "duckduckgo": Provider(0.12, step=0.04, least=0.08, most=5),
    "google_cse": Provider(0.18),
    "brave": Provider(0.17),
    "serpapi": Provider(0.19),
    "searchapi": Provider(0.18),
    "searxng": Provider(0.18, step=0.015, least=0.12, most=6),
}

# Where a provider's JSON answer has its hits, and each hit its URL, title and snippet.
ANSWERS = {
    "clearbit": ("$", "domain", "name", None),
    "google_cse": ("$.items", "link", "title", "snippet"),
    "brave": ("$.web.results", "url", "title", "description"),
    "serpapi": ("$.organic_results", "link", "title", "snippet"),
    "searchapi": ("$.organic_results", "link", "title", "snippet"),
    "searxng": ("$.results", "url", "title", "content"),
    "duckduckgo": ("$.Results", "FirstURL", "Text", None),
}
# The first hit of an answer that is not in its list, and the entities of the one provider that answers with a graph.
ABSTRACT = {"duckduckgo": ("$.AbstractURL", "$.Heading", "$.AbstractText")}
ENTITIES = "map<string,struct<labels:struct<en:struct<value:string>>,descriptions:struct<en:struct<value:string>>,claims:struct<P856:array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>>>"

# Weights of the clean export.
EMAIL_CATEGORY_WEIGHTS = {"business": {"generic": 0.34, "named": 0.28, "external_domain": 0.08, "free_mail": 0.02}, "named": {"generic": 0.30, "named": 0.36, "external_domain": 0.08, "free_mail": 0.02}, "highest": {"generic": 0.18, "named": 0.18, "external_domain": 0.08, "free_mail": 0.02}}
EMAIL_SOURCE_WEIGHTS = {"mailto": 0.16, "json_ld": 0.14, "cloudflare": 0.13, "obfuscated": 0.10, "visible_text": 0.08, "html": 0.02}
PHONE_SOURCE_WEIGHTS = {"tel": 0.22, "json_ld": 0.18, "visible_text": 0.04}
PHONE_TYPE_WEIGHTS = {"MOBILE": 0.05, "FIXED_LINE": 0.04, "FIXED_LINE_OR_MOBILE": 0.04, "TOLL_FREE": 0.03, "VOIP": 0.01}
QUALITY = {"loose": 0.75, "balanced": 0.86, "strict": 0.95}

# Columns of the exports.
LONG_COLUMNS = ("input_row", "input_website", "domain", "data_type", "label", "value", "confidence", "found_via", "page_url", "original_text")
REVIEW_COLUMNS = ("website_finder_status", "website_confidence", "website_source", "website_top_candidates", "scrape_status", "final_url", "domain", "http_status", "fetch_tier", "task_attempts", "notes")
FINDER_COLUMNS = ("website_finder_status", "website_confidence", "website_source", "website_top_candidates")
HIDDEN_COLUMNS = ("website_finder_status", "website_confidence", "website_source", "website_reason", "website_top_candidates", "website_candidates_json", "website_finder_elapsed_ms")
WEBSITE_HEADERS = ("website", "website url", "website_url", "url", "domain", "site")
COMPANY_HEADERS = ("company", "company name", "business", "business name", "name")
LOCATION_HEADERS = ("location", "city", "state", "address", "country")
CLEAN_LABELS = {"website": "Website", "email": "Email", "phone": "Phone", "facebook": "Facebook", "instagram": "Instagram", "linkedin": "LinkedIn", "twitter_x": "X/Twitter", "youtube": "YouTube", "tiktok": "TikTok", "pinterest": "Pinterest", "threads": "Threads", "address": "Address", "description": "Description"}
PASTE_LIMIT, PASTE_CHARS = 100_000, 5_000_000
