"""Fixed values that results depend on."""

# Domains, first labels, path parts and path endings of pages that are not articles.
DOMAINS = ("github.com", "pypi.org", "pypi.python.org", "npmjs.com", "npmjs.org", "crates.io", "packagist.org", "maven.org", "docker.com", "hub.docker.com", "stackoverflow.com", "stackexchange.com", "reddit.com", "quora.com", "medium.com", "docs.google.com", "wikipedia.org", "w3schools.com")
SUBDOMAINS = ("docs", "api", "wiki", "help", "support", "developer", "developers", "learn", "gitbook", "readthedocs", "changelog", "status", "download")
PATH_PARTS = ("/releases/", "/releases", "/tags/", "/commit/", "/tree/", "/blob/", "/pull/", "/issue/", "/issues/", "/pulls/", "/doc/", "/docs/", "/api/", "api-docs", "/changelog", "/wiki/", "/download/", "/login", "/signin", "/signup", "/logout", "/archive", "/search", "/feed", "/rss", "/xml", "/packages/", "/project/", "/projects/", "/documentation/", "/tutorial/", "/tutorials/", "/spec/", "/specs/", "/specification/", "/specifications/")
PATH_ENDS = (".xml", ".rss", ".json", ".zip", ".tar.gz", ".pdf", ".txt", ".exe", ".msi")
# Topics, title phrases and signs of pages that are refused.
TOPICS = ("entertainment", "gaming", "sports", "celebrity", "movies", "music", "pop culture", "playstation", "xbox", "nintendo", "ps5", "fortnite", "nfl", "nba", "mlb", "cricket", "olympics", "movie", "album", "song", "concert", "theater", "hollywood", "actor", "actress", "pypi", "npm", "release notes", "changelog", "stock market", "nasdaq", "dow jones", "s&p 500", "trading", "crypto", "bitcoin", "ethereum", "dogecoin", "jobs report", "unemployment rate", "dependency injection", "pypi package", "pypi release", "npm package", "programming library", "software release")
TITLE_PHRASES = ("api reference", "documentation", "changelog", "release notes", "tutorial", "how to", "getting started", "installation", "404", "not found", "login", "sign in", "sign up", "forgot password", "terms of service", "privacy policy", "pricing", "features")
CODE_SIGNS = ("pip install", "npm install", "yarn add", "composer require", "git clone", "docker pull", "import ", "const ", "require(", "from ... import", "public class ", "def ", "function()", "npm i ", "gem install")
LANDING_SIGNS = ("pricing plan", "monthly plan", "yearly plan", "free trial", "add to cart", "buy now", "check out", "product specs", "all rights reserved", "terms and conditions", "contact support")
BOILERPLATE = ("enable cookies", "please verify you are a human", "access denied", "cloudflare", "javascript is required", "enable javascript", "browser is not supported", "404 not found", "page not found", "login to your account", "invalid request", "forbidden error", "unauthorized access", "checking your browser")
PLACEHOLDERS = ("no sufficient content", "unable to fetch", "error occurred", "this report covers the latest developments", "this article discusses", "in this article", "summarize the following", "here is a summary", "discussing industry impacts, strategic decisions")
# Words that make an article relevant.
PRIORITY = ("manufacturing", "cement", "factory", "automation", "robotics", "kiln", "industrial", "supply chain", "production", "mortar", "concrete", "decarboniz")
# Parameters that do not name a page; country codes' second levels.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "sessionid", "sid", "jsessionid", "phpsessid", "aspsessionid")
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "res", "mil")
# Synonyms; words without a singular.
SYNONYMS = {"artificial intelligence": ("artificial intelligence", "ai", "a.i."), "electric vehicles": ("electric vehicles", "electric vehicle", "ev", "evs"), "machine learning": ("machine learning", "ml")}
SINGULAR_WORDS = ("business", "process", "news", "class", "glass", "robotics", "physics", "metrics", "analytics", "asbestos", "bias", "status", "focus", "gas", "series", "species", "chassis", "sports", "goods", "address")
# Spellings of variants.
VARIANTS = {"ai": "Artificial Intelligence", "artificial intelligence": "Artificial Intelligence", "a.i.": "Artificial Intelligence", "ev": "Electric Vehicles", "electric vehicle": "Electric Vehicles", "electric vehicles": "Electric Vehicles", "ml": "Machine Learning", "machine learning": "Machine Learning"}
# Brands; endings of page names.
BRANDS = ("NVIDIA", "Microsoft", "OpenAI")
PAGE_ENDS = (".html", ".htm", ".shtml", ".php", ".aspx")
# Tags that are placeholders, and tags that are refused.
STALE_LISTS = (("manufacturing", "industrial technology", "general"), ("manufacturing", "automation", "industry insights"), ("manufacturing", "industrial technology", "automation", "ai", "cement industry"))
STALE_WORDS = ("manufacturing", "industrial technology", "general", "automation", "industry insights", "general topic")
FALLBACK_TAGS = ("Manufacturing", "Industrial Technology", "Automation", "AI", "Cement Industry")
FORBIDDEN_TAGS = ("news", "article", "update", "latest", "report", "today", "technology", "business", "company", "information", "general")
FORBIDDEN_KEYWORDS = ("news", "article", "update", "latest", "report", "today", "technology", "business", "company", "information")
# Words and topics of the domain.
DOMAIN_WORDS = ("ai", "ml", "cement", "robot", "robotics", "automation", "manufacturing", "infrastructure", "construction", "sustainability", "energy", "hydrogen", "semiconductor", "battery", "batteries", "decarbonization", "carbon", "supply", "chain", "dalmia", "bharat", "adani", "amazon", "apple")
DOMAIN_TOPICS = ("ai", "artificial intelligence", "ml", "machine learning", "automation", "industrial automation", "cement", "green cement", "dalmia bharat", "dalmia cement", "infrastructure", "construction", "industrial technology", "industrial innovation", "manufacturing", "manufacturing industry", "sustainability", "green energy", "carbon capture", "green hydrogen", "robotics", "robot", "robots", "supply chain", "semiconductor", "ev", "electric vehicle", "electric vehicles", "ev batteries", "battery", "batteries")
# Keywords watched from the start.
WATCHED = ("Artificial Intelligence", "Cybersecurity", "Robotics", "Cloud Computing", "Quantum Computing", "Dalmia Cement", "Manufacturing", "Cement Industry")
# Notices, moods, words of navigation.
SHORT_CONTENT = "No sufficient content available. Title: "
SENTIMENTS = ("Positive", "Neutral", "Negative", "Mixed")
NAV_WORDS = ("login", "sign in", "sign up", "subscribe", "terms of", "privacy policy", "all rights reserved", "copyright", "home", "search", "menu", "share on", "facebook", "twitter", "linkedin", "contact us", "about us", "newsletter")
MOCK_PAGE = ("This is a detailed mock report regarding '{title}'. The current developments in the industry highlight rapid progress and emerging trends across multiple sectors. Companies are actively investing in new solutions to optimize their operations, reduce carbon emissions, and improve productivity.\n\n"
             "Key stakeholders are emphasizing the integration of smart automation technologies to streamline workflows. These initiatives are expected to yield significant cost savings and enhance manufacturing performance over the next decade.")
SUMMARY = "This article discusses key industrial developments and technological advancements in the sector."
# Parts of addresses that are no words.
ARTEFACTS = ("https", "http", "www", "com", "org", "net", "prnewswire", "globenewswire", "newswire", "networknewsaudio", "marketsandmarkets", "pypi", "githubusercontent", "rss", "xml", "feed")
# Elements whose text is left out of a page, and classes and ids of a page's main part.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form", "button")
MAIN_CLASSES = ("post-content", "entry-content", "article-body", "story-body", "article-content", "story-content")
MAIN_IDS = ("article-body", "story-body", "content-body", "main-content")
# Words that do not count as a title's own in the test for tags cut from it.
TITLE_FILLERS = ("news", "article", "update", "latest", "report", "today", "technology", "business", "company", "information", "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "with")
# A default for a parameter; callers bring their own lists.
STOP_WORDS = tuple("a about after all also an and any are as at be been but by can for from had has have he her his how if in into is it its more most new no not of on one or our out over said she so some than that the their them then there they this to under up was we were what when which who will with would you your".split())
