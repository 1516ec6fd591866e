"""Versioned vocabularies that the rules of the engine read. All are small and fixed; rules turn them into literals."""

from __future__ import annotations

TAXONOMY_VERSION = "signals-v1"

# Signal vocabulary.
SIGNAL_TAG_ORDER = (
    "bankruptcy", "m_and_a", "tariff", "sanctions", "strike", "port_strike", "labor_dispute", "supply_disruption",
    "supplier_risk", "quality_issue", "regulatory", "natural_disaster", "price_change", "capacity_change",
    "executive_change", "expansion",
)
PRIORITY_SIGNAL_TAGS = ("bankruptcy", "m_and_a", "port_strike", "quality_issue", "sanctions", "strike", "supply_disruption", "tariff")
SIGNAL_ALIAS_GROUPS = (
    ("bankruptcy", "chapter 11", "insolvency", "liquidation", "receivership"),
    ("m&a", "m_and_a", "acquisition", "deal", "merger", "merger and acquisition", "takeover"),
    ("tariff", "tariffs", "customs", "duties", "export restriction", "import duty", "trade barrier", "trade war"),
    ("sanction", "sanctions", "embargo", "export control", "restricted party", "trade restriction"),
    ("strike", "labor_dispute", "labour dispute", "labor dispute", "industrial action", "port strike", "port_strike", "walkout", "work stoppage"),
    ("supply chain", "supply_chain", "supply disruption", "supply_disruption", "supply shortage", "component shortage", "facility closure", "logistics delay", "logistics delays", "logistics disruption", "port closure", "production halt", "shortage", "transport disruption"),
    ("war", "attack", "conflict", "escalation", "geopolitical", "geopolitical risk", "hostilities", "military action", "missile", "shipping attack"),
    ("middle east", "mideast", "bahrain", "gulf", "hormuz", "iran", "iraq", "israel", "jordan", "kuwait", "lebanon", "oman", "persian gulf", "qatar", "red sea", "saudi arabia", "strait of hormuz", "suez", "syria", "uae", "united arab emirates", "yemen"),
    ("regulation", "regulatory", "compliance", "legislation", "mandate", "policy change"),
    ("quality", "quality issue", "quality_issue", "recall", "defect"),
    ("natural disaster", "natural_disaster", "earthquake", "flood", "hurricane", "typhoon", "wildfire"),
    ("price change", "price_change", "price increase", "price cut", "pricing"),
    ("capacity change", "capacity_change", "expansion", "plant closure", "production capacity"),
)

# Keyword classifier. type, confidence, severity, impact areas, keywords.
SIGNAL_RULES = (
    ("bankruptcy", 0.85, "critical", ("procurement", "supply_chain", "compliance"), ("bankruptcy", "insolvency", "filed for bankruptcy", "chapter 11", "chapter 7", "debt restructuring", "going out of business", "liquidation", "receivership")),
    ("m_and_a", 0.80, "high", ("supply_chain", "pricing", "compliance"), ("acquired", "merger", "acquisition", "merged with", "combine", "consolidation", "buyout", "takeover", "purchase agreement", "deal")),
    ("tariff", 0.78, "high", ("pricing", "procurement", "compliance"), ("tariff", "import duty", "export restriction", "trade war", "sanctions", "embargo", "trade agreement", "customs")),
    ("strike", 0.88, "medium", ("supply_chain", "procurement"), ("strike", "labor strike", "workers strike", "work stoppage", "union strike", "walkout", "industrial action", "streik", "arbeitskampf", "grève", "mouvement social")),
    ("regulatory", 0.75, "medium", ("compliance", "procurement"), ("regulation", "compliance", "mandate", "legislation", "law change", "executive order", "policy change", "requirement", "regulierung", "verordnung", "gesetz", "réglementation", "règlement", "obligation réglementaire")),
    ("supply_disruption", 0.82, "high", ("supply_chain", "procurement"), ("supply chain disruption", "logistics delay", "port closure", "transportation halt", "facility closure", "production halt", "shortage", "supply shortage")),
)

# Impact of a signal type on procurement, supply chain, compliance, pricing; severity factors.
IMPACT = {
    "bankruptcy": (0.95, 0.90, 0.60, 0.70),
    "m_and_a": (0.80, 0.75, 0.70, 0.65),
    "tariff": (0.85, 0.70, 0.90, 0.95),
    "strike": (0.70, 0.85, 0.40, 0.50),
    "regulatory": (0.75, 0.50, 0.95, 0.40),
    "supply_disruption": (0.90, 0.95, 0.50, 0.80),
}
IMPACT_DEFAULT = (0.5, 0.5, 0.5, 0.5)
SEVERITY_FACTOR = {"critical": 1.0, "high": 0.85, "medium": 0.65, "low": 0.40}
SEVERITY_FACTOR_DEFAULT = 0.5
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

# Risk types in order, with aliases, severity and recommendation.
RISK_TYPE_ORDER = ("geopolitical", "regional_conflict", "supply_disruption", "tariff", "sanctions", "regulatory", "bankruptcy", "strike", "quality", "m_and_a", "currency", "logistics", "cybersecurity", "commodity")
RISK_ALIASES = {
    "geopolitical": ("war", "attack", "conflict", "escalation", "geopolitical", "geopolitical risk", "hostilities", "military action", "missile", "shipping attack"),
    "regional_conflict": ("middle east", "mideast", "red sea", "gulf", "hormuz", "strait of hormuz", "suez", "iran", "iraq", "israel", "qatar", "saudi arabia", "uae", "united arab emirates", "yemen"),
    "supply_disruption": ("supply chain", "supply disruption", "supply shortage", "shortage", "factory shutdown", "facility closure", "production halt", "component shortage"),
    "tariff": ("tariff", "tariffs", "customs", "duties", "import duty", "trade duty"),
    "sanctions": ("sanction", "sanctions", "embargo", "export control", "blacklist"),
    "regulatory": ("regulation", "regulatory", "compliance", "legislation", "mandate"),
    "bankruptcy": ("bankruptcy", "chapter 11", "insolvency", "liquidation"),
    "strike": ("strike", "port strike", "labor dispute", "labour dispute", "walkout"),
    "quality": ("quality", "quality issue", "recall", "defect"),
    "m_and_a": ("m&a", "m_and_a", "merger", "acquisition", "takeover", "deal"),
    "currency": ("currency", "foreign exchange", "fx", "euro", "exchange rate"),
    "logistics": ("logistics", "port delay", "shipping delay", "transport disruption"),
    "cybersecurity": ("cyberattack", "cyber attack", "ransomware", "data breach"),
    "commodity": ("commodity", "raw material", "critical minerals", "metals", "energy price"),
}
RISK_SEVERITY = {"bankruptcy": "critical", "geopolitical": "high", "regional_conflict": "high", "sanctions": "high", "supply_disruption": "high", "tariff": "medium", "strike": "medium", "quality": "medium", "regulatory": "medium", "m_and_a": "medium", "currency": "medium", "logistics": "medium", "cybersecurity": "high", "commodity": "medium"}
RISK_RECOMMENDATION = {
    "bankruptcy": "Review supplier continuity and alternate sourcing options before placing new orders.",
    "geopolitical": "Review supplier exposure in this region before placing large orders.",
    "regional_conflict": "Review supplier exposure in this region before placing large orders.",
    "sanctions": "Review compliance exposure before engaging affected suppliers.",
    "supply_disruption": "Review alternate suppliers and inventory coverage.",
    "tariff": "Check landed cost and tariff exposure before confirming new purchase orders.",
    "strike": "Review logistics buffers and supplier delivery commitments.",
    "quality": "Review quality exposure before approving new supplier shipments.",
    "regulatory": "Review compliance requirements before changing supplier commitments.",
    "m_and_a": "Review ownership changes and possible contract or continuity impact.",
    "currency": "Compare timing with the EUR monitor before committing spend.",
    "logistics": "Review transit routes, buffers, and alternate logistics options.",
    "cybersecurity": "Review supplier operational and data exposure before sharing sensitive information.",
    "commodity": "Review price exposure and inventory coverage for affected materials.",
}
RISK_ACTION_PHRASES = ("war", "armed conflict", "regional conflict", "geopolitical risk", "hostilities", "military action", "missile attack", "shipping attack", "attack threatens", "attack disrupts", "escalation of hostilities")
RISK_EXACT_PHRASES = {
    "geopolitical": RISK_ACTION_PHRASES,
    "regional_conflict": RISK_ACTION_PHRASES,
    "tariff": ("tariff increase", "tariff hike", "new tariff", "customs change", "customs duty increase", "duty increase", "import duty", "trade duty"),
    "regulatory": ("new regulation", "regulatory mandate", "compliance requirement", "legislation passed", "legislative requirement"),
    "quality": ("quality issue", "recall", "defect"),
    "m_and_a": ("m&a", "m_and_a", "merger", "acquisition", "takeover"),
    "strike": ("port strike", "labor strike", "labour strike", "union strike", "worker strike", "workers strike", "factory strike", "strike disruption", "labor dispute", "labour dispute", "walkout"),
    "currency": ("foreign exchange", "fx", "exchange rate", "currency risk"),
    "logistics": ("logistics disruption", "port delay", "shipping delay", "transport disruption", "shipping disruption"),
    "commodity": ("commodity price", "raw material shortage", "critical minerals", "energy price"),
}
SEVERITY_OVERRIDE_WORDS = ("bankruptcy", "missile", "shutdown", "embargo")
SEVERITY_OVERRIDE_CRITICAL = ("bankruptcy", "geopolitical", "sanctions")

# Regions in dictionary order, known suppliers, company suffix pattern.
REGION_ALIASES = {
    "us": "United States", "u.s.": "United States", "usa": "United States", "united states": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "united kingdom": "United Kingdom",
    "eu": "European Union", "european union": "European Union", "europe": "Europe", "european": "Europe", "eurozone": "Europe", "brussels": "European Union",
    "asia": "Asia", "middle east": "Middle East", "mideast": "Middle East", "gulf": "Middle East", "persian gulf": "Middle East", "hormuz": "Middle East", "strait of hormuz": "Middle East", "red sea": "Middle East", "suez": "Middle East",
    "bahrain": "Bahrain", "iran": "Iran", "iranian": "Iran", "iraq": "Iraq", "israel": "Israel", "jordan": "Jordan", "kuwait": "Kuwait", "lebanon": "Lebanon", "oman": "Oman", "qatar": "Qatar", "qatari": "Qatar",
    "saudi arabia": "Saudi Arabia", "saudi": "Saudi Arabia", "syria": "Syria", "uae": "United Arab Emirates", "united arab emirates": "United Arab Emirates", "yemen": "Yemen",
    "china": "China", "chinese": "China", "germany": "Germany", "german": "Germany", "deutschland": "Germany", "allemagne": "Germany", "france": "France", "french": "France", "italy": "Italy", "italian": "Italy",
    "netherlands": "Netherlands", "dutch": "Netherlands", "spain": "Spain", "spanish": "Spain", "poland": "Poland", "polish": "Poland", "czech republic": "Czech Republic", "czechia": "Czech Republic",
    "austria": "Austria", "belgium": "Belgium", "sweden": "Sweden", "switzerland": "Switzerland", "swiss": "Switzerland", "denmark": "Denmark", "finland": "Finland", "norway": "Norway", "ireland": "Ireland", "portugal": "Portugal",
    "hungary": "Hungary", "romania": "Romania", "slovakia": "Slovakia", "slovenia": "Slovenia", "lithuania": "Lithuania", "latvia": "Latvia", "estonia": "Estonia",
    "india": "India", "japan": "Japan", "mexico": "Mexico", "canada": "Canada", "brazil": "Brazil", "vietnam": "Vietnam", "taiwan": "Taiwan", "south korea": "South Korea", "korea": "South Korea",
}
KNOWN_SUPPLIERS = ("Anthropic", "Apple", "Bosch", "Critical Metals", "Ferrari", "Genuine Parts", "Mercedes", "Motherson", "Nexans", "OpenAI", "O'Reilly Automotive", "Siemens", "Toyota", "Volkswagen")
COMPANY_SUFFIX = r"\b([A-Z][A-Za-z&'.-]*(?:\s+[A-Z][A-Za-z&'.-]*){0,4}\s+(?:AG|Corp\.?|Corporation|Co\.?|Company|GmbH|Group|Inc\.?|Ltd\.?|PLC|SA|SE))\b"

# Categories, their aliases, and keyword sets in order.
CATEGORIES = ("automotive", "electronics", "chemicals", "raw_materials", "metals_mining", "energy", "manufacturing", "logistics", "packaging", "construction", "food_agriculture", "pharma_healthcare", "aerospace_defense", "retail_consumer", "technology", "finance", "labor", "geopolitical", "sustainability", "regulatory", "general")
CATEGORY_ALIASES = {
    "auto": "automotive", "automobile": "automotive", "automobiles": "automotive", "car": "automotive", "cars": "automotive", "ev": "automotive", "evs": "automotive", "vehicle": "automotive", "vehicles": "automotive",
    "chip": "electronics", "chips": "electronics", "electronic": "electronics", "semiconductor": "electronics", "semiconductors": "electronics",
    "tech": "technology", "software": "technology", "saas": "technology", "cloud": "technology", "artificial intelligence": "technology", "ai": "technology",
    "chemical": "chemicals", "commodity": "raw_materials", "commodities": "raw_materials", "raw material": "raw_materials", "raw materials": "raw_materials", "critical material": "raw_materials", "critical materials": "raw_materials",
    "metal": "metals_mining", "metals": "metals_mining", "mining": "metals_mining", "critical mineral": "metals_mining", "critical minerals": "metals_mining", "lithium": "metals_mining", "copper": "metals_mining", "steel": "metals_mining",
    "freight": "logistics", "shipping": "logistics", "supply chain": "logistics", "supply_chain": "logistics", "transport": "logistics", "transportation": "logistics",
    "factory": "manufacturing", "factories": "manufacturing", "industrial": "manufacturing", "industry": "manufacturing",
    "pack": "packaging", "packaging": "packaging", "container": "packaging", "containers": "packaging", "building": "construction", "construction": "construction", "infrastructure": "construction",
    "agriculture": "food_agriculture", "agri": "food_agriculture", "food": "food_agriculture", "farming": "food_agriculture", "crop": "food_agriculture", "crops": "food_agriculture",
    "pharma": "pharma_healthcare", "pharmaceutical": "pharma_healthcare", "pharmaceuticals": "pharma_healthcare", "healthcare": "pharma_healthcare", "medical": "pharma_healthcare",
    "aerospace": "aerospace_defense", "defence": "aerospace_defense", "defense": "aerospace_defense", "consumer": "retail_consumer", "retail": "retail_consumer",
    "finance": "finance", "financial": "finance", "currency": "finance", "fx": "finance", "labor": "labor", "labour": "labor", "workforce": "labor",
    "geopolitical": "geopolitical", "geopolitics": "geopolitical", "war": "geopolitical", "conflict": "geopolitical",
    "sustainability": "sustainability", "climate": "sustainability", "emissions": "sustainability", "esg": "sustainability",
    "compliance": "regulatory", "legal": "regulatory", "regulation": "regulatory", "regulations": "regulatory",
    "oil": "energy", "gas": "energy", "power": "energy", "renewable": "energy", "renewables": "energy", "utility": "energy", "utilities": "energy",
}
CATEGORY_KEYWORDS = {
    "automotive": ("automotive", "auto", "automobile", "car", "cars", "ev", "fleet", "mobility", "vehicle", "vehicles"),
    "electronics": ("chip", "chips", "electronics", "hardware", "memory", "semiconductor", "semiconductors"),
    "technology": ("ai", "artificial", "cloud", "cybersecurity", "data", "digital", "saas", "software", "tech", "technology"),
    "chemicals": ("chemical", "chemicals", "fertilizer", "plastics", "polymer", "resin"),
    "raw_materials": ("commodity", "commodities", "material", "materials", "raw", "shortage"),
    "metals_mining": ("aluminum", "copper", "critical", "lithium", "metal", "metals", "mineral", "minerals", "mining", "nickel", "rare", "steel"),
    "energy": ("battery", "electricity", "energy", "gas", "oil", "power", "renewable", "renewables", "solar", "utility", "wind"),
    "manufacturing": ("factory", "factories", "industrial", "industry", "manufacturing", "plant", "production"),
    "logistics": ("cargo", "freight", "logistics", "port", "shipping", "supply", "transport", "transportation", "warehouse"),
    "packaging": ("bottle", "box", "container", "containers", "pack", "packaging", "paper", "pallet"),
    "construction": ("building", "cement", "construction", "infrastructure", "lumber", "project"),
    "food_agriculture": ("agriculture", "crop", "crops", "farm", "farming", "food", "grain", "wheat"),
    "pharma_healthcare": ("drug", "healthcare", "medical", "medicine", "pharma", "pharmaceutical", "pharmaceuticals"),
    "aerospace_defense": ("aerospace", "aircraft", "aviation", "defence", "defense", "military"),
    "retail_consumer": ("consumer", "demand", "retail", "store", "stores"),
    "finance": ("currency", "finance", "financial", "fx", "inflation", "rate", "rates"),
    "labor": ("labor", "labour", "strike", "union", "wage", "workforce"),
    "geopolitical": ("conflict", "geopolitical", "geopolitics", "military", "sanctions", "war"),
    "sustainability": ("carbon", "climate", "emissions", "esg", "sustainability", "sustainable"),
    "regulatory": ("compliance", "law", "legal", "policy", "regulation", "regulations", "regulatory", "rules", "sanctions", "tariff", "trade"),
}

# Legal forms, letters that no decomposition strips, least derived alias.
LEGAL_FORMS = ("ag", "gmbh", "mbh", "se", "kg", "kgaa", "ohg", "gbr", "inc", "corp", "corporation", "co", "company", "llc", "lp", "llp", "ltd", "limited", "plc", "sa", "sas", "sarl", "sca", "sl", "sau", "nv", "bv", "cv", "spa", "srl", "snc", "ab", "as", "asa", "oy", "oyj", "aps", "pty", "pte", "bhd", "sdn")
UNDECOMPOSABLE = {"ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ł": "l", "Ł": "l", "þ": "th", "Þ": "th", "ħ": "h", "ı": "i", "ŋ": "n", "ĸ": "k"}
LEAST_DERIVED_ALIAS = 3

# Source trust, quality limits, tracking parameters.
BLOCKED_DOMAINS = ("example-spam.com", "fake-news.ru", "content-farm.com")
LOW_PRIORITY_DOMAINS = ("aggregator.com", "pinterest.com", "instagram.com")
DOMAIN_TRUST = {"reuters.com": 0.95, "bloomberg.com": 0.95, "ft.com": 0.90, "wsj.com": 0.90, "bbc.com": 0.85, "cnbc.com": 0.80, "ec.europa.eu": 0.95, "govinfo.gov": 0.95}
SPAM_WORDS = ("click here", "buy now", "limited offer", "subscribe", "watch video", "ad")
AUTHORITY = {"official": 3, "established_media": 2, "industry": 1}
STABLE_ID_PROVIDERS = ("eu_sanctions",)

# Search terms by query group.
QUERY_GROUPS = {
    "supplier_risk": ("supplier bankruptcy", "manufacturing facility shutdown", "M&A acquisition", "labor strike supplier", "quality issue recall"),
    "logistics_disruption": ("port strike", "logistics disruption", "supply chain delay", "transportation crisis"),
    "tariff_changes": ("tariff increase", "trade sanctions", "export restrictions", "trade agreement"),
    "commodity_prices": ("steel price", "copper price", "aluminum price", "raw material shortage"),
    "regulatory": ("CBAM regulation", "REACH compliance", "supply chain due diligence", "environmental regulation"),
    "regional": ("supply chain Germany", "manufacturing Poland", "industrial Czech Republic", "automotive Mexico"),
    "europe_business": ("Europe business procurement", "European manufacturing suppliers", "Germany industry supply chain", "EU trade business", "France business suppliers"),
}
EUR_QUOTES = ("USD", "GBP", "CHF", "JPY", "CNY", "INR", "PLN", "AUD", "BGN", "BRL", "CAD", "CZK", "DKK", "HKD", "HUF", "IDR", "ILS", "ISK", "KRW", "MXN", "MYR", "NOK", "NZD", "PHP", "RON", "SEK", "SGD", "THB", "TRY", "ZAR")

# Weights and thresholds of enrichment, matching and ranking.
RELEVANCE_WEIGHTS = {"signal": 0.45, "query_group": 0.25, "entity": 0.20, "category": 0.10}
CONFIDENCE_WEIGHTS = {"signal": 0.45, "entity": 0.20, "category": 0.20, "completeness": 0.15}
MIN_RELEVANCE, MIN_CONFIDENCE = 0.35, 0.72
MATCH_WEIGHTS = {"category": 0.30, "supplier": 0.30, "region": 0.20, "signal": 0.20}
RETENTION_DAYS = {"risk_events": 14, "feed": 14, "processed": 30, "raw": 14}


def signal_variants(term: str) -> set[str]:
    return {term, term.replace(" ", "_"), term.replace("_", " ")} - {""}


def normal_term(value: object) -> str:
    return " ".join(str(value).strip().lower().split())


def signal_closure() -> dict[str, frozenset[str]]:
    """Every alias and its spellings, with all terms it stands for: groups that share a spelling are one."""
    groups: list[set[str]] = []
    for aliases in SIGNAL_ALIAS_GROUPS:
        joined = set().union(*map(signal_variants, aliases))
        apart = []
        for g in groups:
            if g & joined:
                joined |= g
            else:
                apart.append(g)
        groups = [*apart, joined]
    return {term: frozenset(g) for g in groups for term in g}


SIGNAL_CLOSURE = signal_closure()


def expand_terms(values) -> frozenset[str]:
    """Terms with all their aliases; a value that no alias names stands for itself and its spellings."""
    out: set[str] = set()
    for value in values:
        for v in signal_variants(normal_term(value)):
            out |= {v} | SIGNAL_CLOSURE.get(v, frozenset())
    return frozenset(out)


def risk_terms(risk_type: str) -> frozenset[str]:
    """The search terms of a risk type; the geopolitical type also has those of regional conflict."""
    own = [risk_type, *RISK_ALIASES[risk_type]]
    if risk_type == "geopolitical":
        own += ["regional_conflict", *RISK_ALIASES["regional_conflict"]]
    return expand_terms(own)
