"""Fixed values of the page classifier: signal table, thresholds, policy and vendor tables."""

from __future__ import annotations

MIN_REAL_PAGE_CHARS = 5_000
LARGE_PAGE_CHARS = 20_000
EMPTY_PAGE_CHARS = 100
BLOCK_SCORE = 45
SUSPICIOUS_SCORE = 20
SOFT_GATE_SCORE = 25
SMALL_PAGE_WEIGHT = 25
SPARSE_DOM_WEIGHT = 20
SCRIPT_HEAVY_WEIGHT = 20

# Fixed values: (pattern, page type, weight, label), searched without regard to case.
# The order is significant: it decides ties between page types.
HARD_SIGNALS = [
    (r"cf_chl_", "CLOUDFLARE", 50, "CF challenge JS token"),
    (r"challenge-platform", "CLOUDFLARE", 50, "CF challenge-platform script"),
    (r"window\._cf_chl", "CLOUDFLARE", 50, "CF challenge JS variable"),
    (r"cf-browser-verification", "CLOUDFLARE", 45, "CF browser verification element"),
    (r"<title[^>]*>Attention Required", "CLOUDFLARE", 45, "CF Attention Required page title"),
    (r"DDoS protection by Cloudflare", "CLOUDFLARE", 50, "CF DDoS protection banner"),
    (r"Checking your browser before", "CLOUDFLARE", 45, "CF browser check message"),
    (r'name="cf-turnstile-response"', "CLOUDFLARE", 50, "CF Turnstile form field"),
    (r"jschl-answer", "CLOUDFLARE", 50, "CF JS challenge answer field"),
    (r"__cf_bm", "CLOUDFLARE", 30, "CF bot management cookie"),
    (r"g-recaptcha", "CAPTCHA", 55, "Google reCAPTCHA widget"),
    (r'class="h-captcha"', "CAPTCHA", 55, "hCaptcha widget class"),
    (r"data-sitekey=", "CAPTCHA", 40, "CAPTCHA sitekey attribute"),
    (r'data-callback="onSubmit"', "CAPTCHA", 35, "CAPTCHA submit callback"),
    (r"verify you are human", "CAPTCHA", 50, "Human verification prompt"),
    (r"FunCaptcha", "CAPTCHA", 50, "Arkose FunCaptcha widget"),
    (r"robot check", "CAPTCHA", 40, "Robot check message"),
    (r"_perimeterx", "BLOCKED", 55, "PerimeterX anti-bot SDK"),
    (r"akamai-abck", "BLOCKED", 50, "Akamai bot manager cookie/JS"),
    (r"px-captcha", "BLOCKED", 50, "PerimeterX captcha widget"),
    (r'"dd":\{"cid"', "BLOCKED", 55, "DataDome JS object"),
    (r"Pardon Our Interruption", "BLOCKED", 50, "Imperva/Incapsula block page"),
    (r"<title[^>]*>Access Denied", "BLOCKED", 50, "Access Denied page title"),
    (r"<title[^>]*>403 Forbidden", "BLOCKED", 45, "403 Forbidden page title"),
    (r"automated queries", "BLOCKED", 45, "Automated query detection"),
    (r"bot detected", "BLOCKED", 55, "Bot detected message"),
    (r"temporarily blocked", "BLOCKED", 40, "Temporarily blocked message"),
    (r"request blocked", "BLOCKED", 40, "Request blocked message"),
    (r"<title[^>]*>429", "RATE_LIMIT", 55, "HTTP 429 page title"),
    (r"too many requests", "RATE_LIMIT", 40, "Too many requests message"),
    (r"sign in to continue", "LOGIN", 45, "Sign-in gate message"),
    (r"login required", "LOGIN", 40, "Login required message"),
    (r"authentication required", "LOGIN", 40, "Authentication required"),
    (r"enable javascript to continue", "JS_REQUIRED", 45, "JS required message"),
    (r'<div id="root"></div>', "JS_REQUIRED", 35, "Empty React root div"),
    (r'<div id="app"></div>', "JS_REQUIRED", 30, "Empty Vue app div"),
    (r"dns_probe_finished", "ERROR", 60, "Chrome DNS probe error"),
    (r"err_connection_refused", "ERROR", 60, "Chrome connection refused error"),
    (r"err_name_not_resolved", "ERROR", 60, "Chrome host resolution error"),
    (r"err_proxy_connection_failed", "ERROR", 60, "Chrome proxy connection failed"),
    (r"err_internet_disconnected", "ERROR", 60, "Chrome internet disconnected"),
    (r"server IP address could not be found", "ERROR", 60, "Chrome server address not found error"),
    (r"site can't be reached", "ERROR", 60, "Browser offline/unreachable error"),
    (r'class="neterror"', "ERROR", 60, "Chrome network error page class"),
    (r'id="main-frame-error"', "ERROR", 60, "Chrome main frame error div"),
    (r'class="icon-offline"', "ERROR", 60, "Chrome offline icon class"),
]

# As above, counted only when the hard score reaches SOFT_GATE_SCORE.
SOFT_SIGNALS = [
    (r"\bcloudflare\b", "CLOUDFLARE", 5, "Cloudflare brand mention"),
    (r"\bcaptcha\b", "CAPTCHA", 5, "captcha word mention"),
    (r"\bdatadome\b", "BLOCKED", 8, "DataDome brand mention"),
    (r"\baccess denied\b", "BLOCKED", 8, "Access denied phrase"),
    (r"\bsecurity check\b", "BLOCKED", 5, "Security check phrase"),
    (r"\brecaptcha\b", "CAPTCHA", 5, "reCAPTCHA mention"),
    (r"\bhcaptcha\b", "CAPTCHA", 5, "hCaptcha mention"),
    (r"\bunusual traffic\b", "BLOCKED", 8, "Unusual traffic mention"),
    (r"\brate.?limit\b", "RATE_LIMIT", 8, "Rate limit mention"),
]

# Protection kind -> recommended next step.
POLICY = {
    "ALLOW": "allow",
    "SOFT_CHALLENGE_WAIT": "reuse_session_wait",
    "INTERACTIVE_CHALLENGE": "force_selenium_interaction",
    "HARD_BLOCK": "fallback_or_rotate",
    "RATE_LIMIT": "burn_proxy_retry_later",
    "LOGIN_WALL": "stop_requires_auth",
    "BROKEN_PROXY": "burn_proxy_keep_session",
    "JS_REQUIRED": "disable_http_temporarily",
    "EMPTY": "retry_or_fallback_browser",
}

# Text fragment -> vendor; the first fragment found wins.
VENDORS = [
    ("cloudflare", "Cloudflare"),
    ("datadome", "DataDome"),
    ("akamai", "Akamai"),
    ("perimeterx", "PerimeterX"),
    ("imperva", "Imperva"),
    ("incapsula", "Imperva"),
    ("turnstile", "Cloudflare"),
    ("captcha", "CAPTCHA"),
]

PROXY_FAULT_TOKENS = ["proxy", "dns", "connection", "offline"]
INTERACTIVE_TOKENS = ["turnstile", "captcha", "verification", "checking your browser"]
FAILURE_KINDS = ["INTERACTIVE_CHALLENGE", "HARD_BLOCK", "RATE_LIMIT"]
DISTRUST_KINDS = ["JS_REQUIRED", "INTERACTIVE_CHALLENGE", "HARD_BLOCK"]

# Probe acceptance.
MIN_PROBE_TEXT_CHARS = 500
MIN_BROWSER_SUCCESSES = 2
MIN_SIMILARITY = 0.75
SIMILARITY_TEXT_CHARS = 20_000
REFERENCE_TEXT_CHARS = 12_000
RECENT_SIMILARITIES = 10

# Session trust in thousandths.
TRUST_START, TRUST_UP, TRUST_DOWN, TRUST_MAX = 500, 100, 150, 1000

# Classifier votes.
ML_BLOCK_CONFIDENCE = 0.6
ML_BLOCKED_CLASSES = ["CLOUDFLARE", "CAPTCHA", "BLOCKED", "RATE_LIMIT", "EMPTY"]
LABEL_MAP = {"bot_detected": "BLOCKED", "blocked": "BLOCKED", "normal": "NORMAL", "neutral": "NEUTRAL"}
