"""Fixed values that results depend on."""

#: Sources in their order, and the role of each.
SOURCES = ("ARXIV", "GITHUB", "HUGGING_FACE", "HACKER_NEWS", "HACKER_NEWS_SEARCH", "WEIBO_HOT_SEARCH", "TWITTER", "BING_SEARCH", "DUCKDUCKGO_SEARCH", "SOGOU_SEARCH")
ROLES = {
    "ARXIV": "PRIMARY",
    "GITHUB": "ADOPTION",
    "HUGGING_FACE": "ADOPTION",
    "HACKER_NEWS": "COMMUNITY",
    "HACKER_NEWS_SEARCH": "COMMUNITY",
    "WEIBO_HOT_SEARCH": "COMMUNITY",
    "TWITTER": "COMMUNITY",
    "BING_SEARCH": "DISCOVERY",
    "DUCKDUCKGO_SEARCH": "DISCOVERY",
    "SOGOU_SEARCH": "DISCOVERY",
}
#: Code, target, greatest deviation, and greatest deviations of high and medium confidence, in seconds.
WINDOWS = (("1h", 3600, 900, 300, 600), ("6h", 21600, 3600, 1200, 2400), ("24h", 86400, 10800, 1800, 5400), ("3d", 259200, 43200, 10800, 21600))
#: Raw metrics of each source by kind, and the weight of a kind in growth rates.
METRICS = {
    "ARXIV": {"authorsCount": "MONO", "categoriesCount": "MONO"},
    "GITHUB": {"stargazersCount": "MONO", "forksCount": "MONO", "watchersCount": "MONO", "openIssuesCount": "VOLATILE"},
    "HUGGING_FACE": {"downloads": "MONO", "likes": "MONO"},
    "HACKER_NEWS": {"points": "VOLATILE", "commentsCount": "VOLATILE"},
    "HACKER_NEWS_SEARCH": {"points": "VOLATILE", "commentsCount": "VOLATILE"},
    "TWITTER": {"likeCount": "VOLATILE", "retweetCount": "VOLATILE", "replyCount": "VOLATILE", "quoteCount": "VOLATILE", "viewCount": "VOLATILE"},
    "WEIBO_HOT_SEARCH": {"points": "VOLATILE", "rank": "RANK"},
    "BING_SEARCH": {"rank": "RANK", "totalCount": "RELEVANCE", "score": "RELEVANCE"},
    "DUCKDUCKGO_SEARCH": {"rank": "RANK", "totalCount": "RELEVANCE", "score": "RELEVANCE"},
    "SOGOU_SEARCH": {"rank": "RANK", "totalCount": "RELEVANCE", "score": "RELEVANCE"},
}
GROWTH_WEIGHTS = {"MONO": 1.0, "VOLATILE": 0.6, "RANK": 0.3, "RELEVANCE": 0.0}
#: Event types in order of priority, each with the substrings that tell it.
EVENT_TYPES = (
    ("SECURITY_INCIDENT", ("vulnerab", "security flaw", " cve", "exploit", "0day", "zero-day", "leak")),
    ("ACQUISITION", ("acquir", "acquisition", "buys ", "buyout", "merger", "merges with")),
    ("FUNDING", ("raises ", "raising ", "funding round", "series a", "series b", "series c", "investment", "valuation")),
    ("PRICING", ("pricing", "price cut", "price increase", "fee", "subscription cost", "api cost")),
    ("POLICY", ("policy", "regulation", "regulated", "banned", "ban ", "compliance")),
    ("BENCHMARK", ("benchmark", "leaderboard", "evaluates", "evaluation results", "comparison")),
    ("RESEARCH", (" arxiv", "paper:", "research paper", "we propose", "we present", "in this paper")),
    ("OPEN_SOURCE", ("open source", "open-source", "open weights", "open-weights", "released under mit", "apache 2.0")),
    ("UPDATE", ("update", "patch", "upgrade", "hotfix", "version bump", "rolls out", "ships patch")),
    ("RELEASE", ("launches", "launch", "announces", "announce", "unveils", "unveil", "ships", "released", "releases", "introduces", "debuts", "publishes", "publish", "drops", "general availability", "ga ")),
)
#: Entities by type and canonical name, with display name and further aliases.
ENTITIES = (
    ("PRODUCT", "gpt-5", ("GPT-5", "GPT5", "gpt 5", "GPT–5")),
    ("PRODUCT", "gpt-4", ("GPT-4", "GPT4", "gpt 4")),
    ("PRODUCT", "claude-code", ("Claude Code", "ClaudeCode", "claude code")),
    ("PRODUCT", "claude", ("Claude",)),
    ("PRODUCT", "llama-3", ("Llama 3", "Llama3", "llama-3", "Llama 3.1", "Llama-3.1")),
    ("PRODUCT", "llama", ("Llama",)),
    ("PRODUCT", "gemini", ("Gemini",)),
    ("PRODUCT", "midjourney", ("Midjourney",)),
    ("PRODUCT", "stable-diffusion", ("Stable Diffusion", "StableDiffusion")),
    ("ORG", "openai", ("OpenAI", "Open AI")),
    ("ORG", "anthropic", ("Anthropic",)),
    ("ORG", "meta", ("Meta",)),
    ("ORG", "google", ("Google",)),
    ("ORG", "deepmind", ("DeepMind",)),
    ("ORG", "mistral", ("Mistral", "Mistral AI")),
    ("ORG", "deepseek", ("DeepSeek",)),
    ("ORG", "hugging-face", ("Hugging Face", "HuggingFace", "HF")),
    ("ORG", "nvidia", ("NVIDIA",)),
    ("ORG", "microsoft", ("Microsoft",)),
    ("ORG", "amazon", ("Amazon",)),
    ("ORG", "apple", ("Apple",)),
)
#: Words that are no keywords.
STOP_WORDS = tuple(
    "the a an and or but for to of in on at by with from into is are be been was were this that these those it its as if then than "
    "we you they he she our their his her new more most very just also about after before announces announced says said reports reported "
    "via re fw sec etc".split()
)
#: What a blocked and an empty result page says.
BLOCKED = (
    "captcha", "recaptcha", "hcaptcha", "cf-challenge", "cloudflare", "verify you are human", "human verification", "prove you're not a robot", "access denied",
    "you have been blocked", "unusual traffic", "please complete the security check", "checking your browser", "enable javascript", "javascript is disabled",
)
EMPTY_RESULT = ("no results found", "no matches found", "your search did not match any documents", "we couldn't find anything", "nothing matched your search", "no results for", "did not match")
#: Query parameters that canonical and sanitized URLs drop.
TRACKING = ("ref", "source", "fbclid", "gclid")
SANITIZED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref")
#: Weights of the second score's components, and authority of each role.
SCORE_WEIGHTS = {"momentum": 0.25, "adoption": 0.15, "freshness": 0.15, "relevance": 0.15, "authority": 0.10, "discussion": 0.10, "evidenceDiversity": 0.10}
AUTHORITY = {"PRIMARY": 85.0, "ADOPTION": 60.0, "MEDIA": 55.0, "COMMUNITY": 45.0, "DISCOVERY": 25.0}
PRIMARY_RANK = {"PRIMARY": 5, "ADOPTION": 4, "MEDIA": 3, "COMMUNITY": 2, "DISCOVERY": 1}
CONFIDENCE_FACTOR = {"HIGH": 1.0, "MEDIUM": 0.85, "LOW": 0.6}
#: Confidence from strongest to weakest.
CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "METRIC_RESET", "DATA_ANOMALY", "UNKNOWN")
#: What ids look like in URLs, and an arXiv number in a text; what an editorial lead of a title looks like.
ID_PATTERNS = {
    "arxiv": r"^https?://arxiv\.org/(?:abs|pdf)/([^/?#\s]+?)(?:\.pdf)?(?:[/?#].*)?$",
    "github": r"^https?://github\.com/([^/\s]+)/([^/?#\s]+)(?:[/?#].*)?$",
    "hf_model": r"^https?://huggingface\.co/([^/\s]+)/([^/?#\s]+?)(?:[/?#].*)?$",
    "hn_item": r"^https?://news\.ycombinator\.com/item\?id=(\d+)$",
    "tweet": r"^https?://(?:twitter|x)\.com/([^/\s]+)/status/(\d+)$",
    "said": r"(?i)\b(?:arxiv[:\s]+)?(\d{4}\.\d{4,5})\b",
}
EDITORIAL = r"(?i)^(breaking|announcement|news|update|update\s*\d*|hot|exclusive|\[\s*[a-z\s_-]+\s*\]|\(\s*[a-z\s_-]+\s*\))\s*[:\-]\s*"
