"""Word lists, patterns and constants whose exact content decides results.

Nothing here is logic.  The lists keep the order in which alternatives are tried.
"""

# ---- Fixed values: listing states and eligibility -------------------------------------------
POSITIVE_ELIGIBILITY = ["eligible_verified", "eligible_likely"]
GATE_ELIGIBLE_SCOPES = ["worldwide", "apac_incl_ph", "ph_only"]
RECOVERABLE_REASONS = ["stale-feed", "link-unavailable"]
JOB_TYPES = ["VA", "freelance", "project", "full-time", "part-time"]
LOCATION_TYPES = ["remote", "hybrid", "onsite"]
EXPERIENCE_LEVELS = ["entry", "mid", "senior", "any"]
BOARD_CATEGORIES = ["customer-service", "admin", "marketing", "design", "tech", "finance", "other"]
DIRECTORY_NICHES = ["australian-dayshift", "global-va", "bpo", "job-boards", "ecommerce", "tech"]
EXCERPT_PLATFORMS = ["WeWorkRemotely", "Remotive", "RealWorkFromAnywhere", "Jobicy", "RemoteOK"]

# ---- Fixed values: geographic signals -------------------------------------------------------
PH_POSITIVE = [
    "philippines", "philippine", "filipino", "filipina", "manila", "cebu", "davao", "quezon city",
    "makati", "taguig", "pasig", "iloilo", "bacolod", "baguio", "cagayan de oro", "ph[- ]based",
]
APAC_POSITIVE = ["apac", "asia[- ]pacific", "south[- ]?east asia", "southeast asia", "asia"]
WORLDWIDE = [
    "anywhere in the world", "worldwide", "work from anywhere", "anywhere", "global(?:ly)?[- ]remote",
    "remote[- ]global", "100% remote", "fully remote", "open to all locations",
    "location[- ]independent", "probably worldwide",
]
COUNTRIES = [
    "united states", "usa", r"u\.s\.a?\.", "america", "canada", "united kingdom", "uk", "england",
    "scotland", "wales", "ireland", "germany", "deutschland", "france", "spain", "españa", "italy",
    "italia", "switzerland", "austria", "netherlands", "belgium", "luxembourg", "portugal", "poland",
    "czechia", "czech republic", "romania", "hungary", "sweden", "norway", "denmark", "finland",
    "iceland", "estonia", "latvia", "lithuania", "greece", "croatia", "bulgaria", "slovakia",
    "slovenia", "ukraine", "türkiye", "turkey", "israel", "uae", "dubai", "saudi arabia", "qatar",
    "egypt", "south africa", "nigeria", "kenya", "ghana", "morocco", "brazil", "brasil", "mexico",
    "méxico", "argentina", "colombia", "chile", "peru", "perú", "uruguay", "ecuador", "costa rica",
    "panama", "australia", "new zealand", "japan", "south korea", "korea", "china", "hong kong",
    "taiwan", "singapore", "malaysia", "thailand", "vietnam", "indonesia", "india", "pakistan",
    "bangladesh", "sri lanka", "nepal",
]
US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware",
    "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico",
    "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania",
    "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont",
    "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
]
CITIES = [
    "london", "berlin", "munich", "hamburg", "frankfurt", "paris", "lyon", "madrid", "barcelona",
    "milan", "rome", "lugano", "zurich", "zürich", "geneva", "bern", "vienna", "amsterdam",
    "rotterdam", "brussels", "lisbon", "porto", "warsaw", "krakow", "prague", "budapest",
    "bucharest", "dublin", "stockholm", "oslo", "copenhagen", "helsinki", "athens", "toronto",
    "vancouver", "montreal", "ottawa", "sydney", "melbourne", "brisbane", "auckland", "wellington",
    "tokyo", "seoul", "tel aviv", "new york city", "san francisco", "los angeles", "seattle",
    "boston", "chicago", "houston", "austin", "dallas", "denver", "miami", "atlanta",
    "philadelphia", "phoenix", "portland", "san diego", "nashville",
]
REGIONS_EXCLUDING_PH = [
    "emea", "europe", "european union", "eu only", "eea", "latam", "latin america", "north america",
    "americas", "middle east", "africa", "nordics", "dach", "benelux", "oceania", "anz",
]
RESIDENCE_LOCKS = [
    "must (?:be )?(?:based|located|residing|reside|live|living) in(?: the)? [a-zà-ÿ]",
    r"based in(?: the)? (?:us|usa|uk|eu|europe|canada|australia)\b",
    "residents? (?:of|only)",
    "citizens? (?:of|only)",
    "citizenship (?:is )?required",
    "(?:us|uk|eu|canadian|australian) work (?:authorization|authorisation|permit)",
    "authorized to work in",
    "authorised to work in",
    "eligible to work in(?: the)? (?:us|usa|uk|eu|europe|canada|australia)",
    "work permit (?:for|in|required)",
    "valid (?:us|uk|eu) work",
    "local(?:ly)? (?:candidates|applicants) only",
    "(?:us|uk|eu|canada|australia)[- ]only",
    "only (?:us|uk|eu|canadian|australian) (?:candidates|applicants|residents)",
]
ONSITE = ["on[- ]?site", "in[- ]office", "hybrid"]
LANGUAGE_TAGS = [
    "italian", "german", "french", "spanish", "portuguese", "dutch", "polish", "swedish",
    "norwegian", "danish", "finnish", "czech", "hungarian", "romanian", "turkish", "japanese",
    "korean", "mandarin", "cantonese",
]
GEO_RESTRICTIONS = [
    "us only", "united states only", "us citizens? only", "us residents? only", "uk only",
    "united kingdom only", "uk residents? only", "canada only", "canadian residents? only",
    "europe only", "european residents? only", "must be in the us", "must reside in the us",
    "must be located in the us", "must be us resident", "authorized to work in the us",
    "authorized to work in us", "citizenship required", "work from the us", "us timezone only",
    "est only", "pst only", "mst only", "cst only", "north america only",
]
LOCAL_ONLY = [
    "m/w/d", "w/m/d", "m/w/x", "d/m/w", "h/f", "werkstudent", "werkstudenten", "alternance",
    "apprentissage", "cdd", "cdi", "praktikum", "praktikant", "stagiaire", "stellenangebot",
    "vollzeit", "teilzeit",
]

# ---- Fixed values: stopwords per language, first listed wins ties --------------------------
WORD_CHARS = "a-zà-ÿœßąćęłńóśźż"
STOPWORDS = {
    "it": [
        "di", "il", "la", "che", "per", "con", "del", "della", "delle", "sono", "siamo", "nostro", "nostra", "lavoro",
        "azienda", "cerchiamo", "ricerca", "requisiti", "esperienza", "gestione", "clienti", "attività", "servizio",
        "durante", "essere", "presso",
    ],
    "de": [
        "der", "die", "das", "und", "für", "mit", "wir", "sie", "bei", "eine", "einen", "einem", "unser", "unsere",
        "arbeit", "erfahrung", "kenntnisse", "aufgaben", "unternehmen", "suchen", "bewerbung", "sowie", "oder",
        "nicht", "werden",
    ],
    "fr": [
        "le", "les", "des", "une", "et", "pour", "avec", "nous", "vous", "notre", "dans", "poste", "entreprise",
        "expérience", "recherche", "mission", "gestion", "clients", "être", "vos", "nos", "chez", "afin", "ainsi",
    ],
    "es": [
        "el", "los", "las", "una", "para", "con", "que", "nuestro", "nuestra", "empresa", "trabajo", "experiencia",
        "buscamos", "gestión", "clientes", "servicio", "requisitos", "estamos", "sobre", "como", "más", "años",
    ],
    "pt": [
        "os", "as", "um", "uma", "para", "com", "que", "nosso", "nossa", "empresa", "trabalho", "experiência",
        "buscamos", "gestão", "clientes", "serviço", "você", "são", "não", "mais", "anos",
    ],
    "nl": [
        "de", "het", "een", "en", "voor", "met", "wij", "bij", "ons", "onze", "werk", "ervaring", "bedrijf", "zoeken",
        "klanten", "jouw", "je", "niet", "zijn", "worden",
    ],
    "pl": [
        "się", "jest", "praca", "firma", "doświadczenie", "klientów", "zespołu", "oferujemy", "wymagania", "oraz",
        "dla", "nie", "być", "pracy", "których",
    ],
}
ENGLISH_STOPWORDS = [
    "the", "and", "for", "with", "you", "our", "are", "will", "have", "this", "that", "from", "your", "work", "team",
    "role", "experience", "skills", "we", "to", "of", "in", "is", "on", "as", "be", "an",
]

# ---- Fixed values: role relevance and categories -------------------------------------------
PLACEHOLDER_TITLES = ["", "test", "sdf", "asdffd", "sadfsdf", "sdsfda"]
RELEVANT_ROLES = [
    "admin", "assistant", "virtual assistant", "customer", "support", "success", "marketing", "sales",
    "seo", "content", "writer", "copywriter", "editor", "designer", "design", "developer", "engineer",
    "software", "data", "analyst", "bookkeeper", "accounting", "finance", "operations", "recruiter",
    "hr", "project manager", "product manager", "program manager", "qa", "tester", "testing",
    "e-?commerce", "shopify", "community", "technical", "devops", "it support", "head of", "vp",
    "vice president", "chief", "director", "lead", "manager", "strategy", "coordinator", "scheduler",
    "executive assistant", "social media",
]
PHYSICAL_ROLES = [
    "courier", "mail carrier", "driver", "delivery", "warehouse", "forklift", "photographer",
    "civil engineer", "logistics", "fulfillment operations",
]
PHYSICAL_TITLE_WORDS = [
    "courier", "mail carrier", "driver", "delivery", "warehouse", "photographer", "civil engineer",
    "logistics", "fulfillment operations",
]
BOARD_CATEGORY_WORDS = {
    "tech": "developer|engineer|programmer|software|web|full stack|backend|frontend|react|node|tech|data|python",
    "marketing": "marketing|seo|social media|content|sales|copywriter|growth|outreach",
    "design": "design|ui|ux|graphic|illustrator|video|animat|creative",
    "customer-service": "customer|support|chat|ticket|csr|client",
    "admin": "admin|virtual assistant|data entry|hr|recruiter|operation|executive|management",
    "finance": "bookkeeper|accounting|finance|audit|billing|collections|payroll",
}
HEURISTIC_CATEGORY_WORDS = {
    "admin": ("admin|assistant|data entry", ["assistant", "admin"]),
    "tech": ("developer|engineer|code|tech", ["software-development", "tech"]),
    "design": ("design|writer|creative|copywriter", ["creative", "content"]),
    "marketing": ("social|instagram|facebook|marketing", ["marketing", "social-media"]),
    "customer-service": ("support|customer|chat", ["customer-support", "helpdesk"]),
    "finance": ("bookkeeper|accounting|finance", ["finance", "accounting"]),
}
CATEGORY_ALIASES = {
    "admin": "admin", "design": "design", "creative": "design", "tech": "tech",
    "marketing": "marketing", "social-media": "marketing", "customer-service": "customer-service",
    "customer-support": "customer-service", "finance": "finance",
}
EMPLOYMENT_TYPES = {
    "full-time": "FULL_TIME", "part-time": "PART_TIME", "freelance": "CONTRACTOR",
    "project": "TEMPORARY", "VA": "CONTRACTOR",
}
VOTE_CATEGORIES = ["admin", "design", "tech", "marketing", "customer-service", "finance", "other"]
VOTE_EMPLOYMENT = ["full-time", "part-time", "contract", "freelance"]

# ---- Fixed values: companies ----------------------------------------------------------------
NAME_BLOCKLIST = [
    "unknown", "n/a", "na", "none", "null", "confidential", "undisclosed", "private", "various",
    "multiple", "remote", "digital", "hiring", "hirings", "careers", "career", "jobs", "job",
    "company", "stealth", "stealth startup", "recruitment", "recruiter", "staffing", "agency",
    "client", "employer",
]
GENERIC_WORDS = [
    "tech", "technologies", "solutions", "services", "group", "labs", "studio", "consulting",
    "global", "international", "worldwide", "online", "media",
]
TRUSTED_HOSTS = [
    "weworkremotely.com", "realworkfromanywhere.com", "jobicy.com", "remotive.com",
    "boards.greenhouse.io", "boards-api.greenhouse.io", "jobs.ashbyhq.com", "api.ashbyhq.com",
    "jobs.lever.co", "api.lever.co", "breezy.hr", "apply.workable.com",
]

# ---- Fixed values: applicant-tracking endpoints ({} is the tenant token) --------------------
ATS_ENDPOINTS = {
    "lever": "https://api.lever.co/v0/postings/{}?mode=json",
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs",
    "workable": "https://apply.workable.com/api/v3/accounts/{}/jobs",
    "breezy": "https://{}.breezy.hr/json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}",
}
ATS_CAREER_PAGES = {
    "greenhouse": "https://boards.greenhouse.io/{}",
    "lever": "https://jobs.lever.co/{}",
    "ashby": "https://jobs.ashbyhq.com/{}",
    "breezy": "https://{}.breezy.hr",
    "workable": "https://apply.workable.com/{}",
}

# ---- Fixed values: link health --------------------------------------------------------------
PARKED_MARKERS = [
    "this domain is for sale", "buy this domain", "domain is for sale", "domain may be for sale",
    "this website is for sale", "domain parking", "parked free", "sedoparking", "hugedomains",
    "afternic", "godaddy.com/domainsearch", "interested in this domain",
    "account suspended", "site not found", "this site can not be reached",
]
GONE_STATUSES = [404, 410, 451]
BOT_WALL_STATUSES = [401, 403, 405, 406, 409, 418, 429]
LINK_STATUSES = ["ok", "bot_wall", "dead_http", "unreachable", "dead_dns", "parked", "no_url"]
UNREACHABLE_REASONS = [
    "TIMEOUT", "DNS_FAILURE", "TLS_FAILURE", "CONNECT_FAILURE", "EGRESS_BLOCKED", "REQUEST_ERROR",
    "UNKNOWN_NETWORK",
]
# reason -> (pattern over upper-cased codes and name, pattern over lower-cased message)
UNREACHABLE_RULES = {
    "TIMEOUT": (
        "ABORT|TIMEOUT|ETIMEDOUT|ESOCKETTIMEDOUT|UND_ERR_(CONNECT_TIMEOUT|HEADERS_TIMEOUT|BODY_TIMEOUT)",
        "timed out|timeout"),
    "DNS_FAILURE": ("ENOTFOUND|EAI_AGAIN|EAI_FAIL|EAI_NONAME", "could not resolve| dns "),
    "TLS_FAILURE": ("CERT|SSL|TLS|EPROTO|SELF_SIGNED|UNABLE_TO_VERIFY|ERR_TLS",
                    "certificate| ssl|handshake"),
    "CONNECT_FAILURE": (
        "ECONNREFUSED|ECONNRESET|ECONNABORTED|EHOSTUNREACH|ENETUNREACH|EHOSTDOWN|EPIPE|UND_ERR_SOCKET",
        "connection refused|connection reset|connection closed"),
    "EGRESS_BLOCKED": (None, "too many subrequests|network connection lost|egress|blocked|proxy"),
}

# ---- Fixed values: counters of a run summary and named entities ----------------------------
COUNTERS = [  # order is severity; a summary is cut from its end
    ("insert_failed_batches", "insertFailedBatches"), ("insert_errors", "insertErrors"),
    ("rejected_failed_batches", "rejectedInsertFailedBatches"),
    ("pending_failed_batches", "pendingInsertFailedBatches"),
    ("fetch_event_failed_batches", "fetchEventFailedBatches"), ("triage_failures", "triageFailures"),
    ("triage_unavailable", "triageAiUnavailable"), ("provider_failures", "aiProviders"),
    ("triage_deferred", "triageBudgetDeferred"), ("failed_sources", "failedSources"),
    ("dropped_no_url", "droppedNoUrl"),
]
NAMED_ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
