"""Word lists, tables and patterns that results depend on."""

# Unicode blocks of the nine Indic scripts.
INDIC_BLOCKS = {
    "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FF),
    "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF),
    "Odia": (0x0B00, 0x0B7F),
    "Tamil": (0x0B80, 0x0BFF),
    "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF),
    "Malayalam": (0x0D00, 0x0D7F),
}

# The language that a script stands for.
SCRIPT_LANGUAGE = {
    "Devanagari": "hindi",
    "Bengali": "bengali",
    "Gujarati": "gujarati",
    "Gurmukhi": "punjabi",
    "Kannada": "kannada",
    "Malayalam": "malayalam",
    "Odia": "odia",
    "Tamil": "tamil",
    "Telugu": "telugu",
    "Latin": "english",
    "Mixed": "mixed",
}

# Legal suffixes at a name's end, first match wins.
LEGAL_SUFFIXES = [
    (
        r"private\s+limited|pvt\s+ltd|pvt\s+limited|private\s+ltd|pvt|praiveta\s+limiteda|pra\s+li"
        r"|bhiraivedh\s+(?:limidhedh|ltd|limited)|praivarr\s+(?:limirrad|ltd|limited)|praivet\s+(?:ltd|limited|limiteda)"
        r"|praibheta\s+(?:ltd|limited|limiteda)|praibhet\s+(?:ltd|limited|limiteda)|praiveta\s+(?:limatida|ltd|limited|limiteda)",
        "pvt ltd",
    ),
    (r"public\s+limited|plc", "plc"),
    (r"limited|ltd|limiteda|limidhedh|limirrad|limatida", "ltd"),
    (r"limited\s+liability\s+company|llc", "llc"),
    (r"limited\s+liability\s+partnership|llp|elaelapi|elelbhi|elelpi|elel\s+pi|el\s+pi", "llp"),
    (r"incorporated|inc", "inc"),
    (r"corporation|corp", "corp"),
    (r"company|co", "co"),
]

# Transliterated business words and their English forms.
BUSINESS_TERMS = {
    "marketimga": "marketing",
    "praopartija": "properties",
    "emtarapraijeja": "enterprises",
    "emtar": "enterprise",
    "tredimga": "trading",
    "tredimg": "trading",
    "tredarsa": "traders",
    "imdastrija": "industries",
    "imdastris": "industries",
    "teknolaojija": "technologies",
    "teknolaoji": "technology",
    "teknalajis": "technologies",
    "teknalaji": "technology",
    "teka": "tech",
    "tek": "tech",
    "sarviseja": "services",
    "saolyusamsa": "solutions",
    "solyusans": "solutions",
    "laojistiksa": "logistics",
    "enarji": "energy",
    "aiti": "it",
    "globala": "global",
    "imtaranesanala": "international",
    "phudsa": "foods",
    "phuds": "foods",
    "phuda": "food",
    "phud": "food",
    "impeksa": "impex",
    "impeks": "impex",
    "imjiniyarimga": "engineering",
    "kamstraksamsa": "constructions",
    "kamstraksana": "construction",
    "straksans": "constructions",
    "prodaktsa": "products",
    "prodakts": "products",
    "devalaparsa": "developers",
    "esteta": "estate",
    "estet": "estate",
    "midiya": "media",
    "egro": "agro",
    "projektsa": "projects",
    "prajekts": "projects",
    "vemcarsa": "ventures",
    "eksaportsa": "exports",
    "prodyusara": "producer",
    "pavara": "power",
    "sistamsa": "systems",
    "bildarsa": "builders",
    "investamemtsa": "investments",
    "investamemta": "investment",
    "invest": "investments",
    "bijanesa": "business",
    "phaumdesana": "foundation",
    "phaumdesan": "foundation",
    "kamsaltemtsa": "consultants",
    "kamsaltimga": "consulting",
    "kamsaltemsi": "consultancy",
    "kansaltensi": "consultancy",
    "phainemsa": "finance",
    "phainans": "finance",
    "keyara": "care",
    "ker": "care",
    "imphra": "infra",
    "imphrastrakcara": "infrastructure",
    "phrastrakcar": "infrastructure",
    "saophtaveyara": "software",
    "sapht": "software",
    "mainejamemta": "management",
    "memt": "management",
    "imphoteka": "infotech",
    "helthakeyara": "healthcare",
    "haospitailiti": "hospitality",
    "haspitaliti": "hospitality",
    "hotala": "hotel",
    "dijitala": "digital",
    "haiteka": "hitech",
    "krietiva": "creative",
    "yunika": "unique",
    "yunivarsala": "universal",
    "suprima": "supreme",
    "primiyara": "premier",
    "gaileksi": "galaxy",
    "motarsa": "motors",
    "pharmesi": "pharmacy",
    "pharnicara": "furniture",
    "provijana": "provision",
}

# Country aliases.
COUNTRIES = {
    "in": "india", "ind": "india", "india": "india", "republic of india": "india", "bharat": "india", "us": "united states",
    "usa": "united states", "u s a": "united states", "u s": "united states", "united states": "united states",
    "united states of america": "united states", "fr": "france", "fra": "france", "france": "france", "french republic": "france",
    "republique francaise": "france", "uk": "united kingdom", "gbr": "united kingdom", "gb": "united kingdom",
    "united kingdom": "united kingdom", "great britain": "united kingdom", "de": "germany", "deu": "germany",
    "germany": "germany", "deutschland": "germany", "ca": "canada", "can": "canada", "canada": "canada",
}

# Tokens that never make a blocking key.
LEGAL_TOKENS = """
    pvt ltd llc llp inc corp co plc private limited company corporation incorporated liability partnership public
    limiteda limidhedh limirrad limatida praiveta praivet praibheta praibhet bhiraivedh praivarr elaelapi elelbhi elelpi
""".split()
GENERIC_TOKENS = """
    group associates association society trust foundation federation council committee board agency bureau institute institution
    services solutions enterprises industries technologies technology tech trading traders marketing properties logistics energy
    global international foods food impex engineering constructions construction products developers estate media agro projects
    ventures exports producer power systems builders investments investment business consulting consultants consultancy finance
    care infra infrastructure software management infotech healthcare hospitality hotel digital hitech creative unique universal
    supreme premier motors pharmacy furniture provision new old big sri shri shree sree the and of for in at to on &
""".split()
HONORIFIC_TOKENS = "mr mrs ms m/s m-s messrs dr prof sir smt shri sri shree sree kumari late son sons brothers bros".split()
STOPWORDS = sorted({*LEGAL_TOKENS, *GENERIC_TOKENS, *HONORIFIC_TOKENS})

# Patterns of address numbers and postal codes.
ADDRESS_NUMBER = r"(?:^|\s|#)(\d+(?:[/-][A-Za-z0-9]+)?)(?:\s|$|[,;])"
NUMERIC_TOKEN = r"\b\d+(?:[/-][a-zA-Z0-9]+)?\b|\b\d+[a-zA-Z]?\b"
PIN_CODE, ZIP_CODE = r"\b([1-9]\d{5})\b", r"\b(\d{5}(?:-\d{4})?)\b"

# Texts that mean a missing value.
SENTINELS = ["", "none", "nan", "null"]

# Thresholds that the out-of-fold search tries, and those of the default sweep.
SEARCH_GRID = [0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.22, 0.25, 0.27, 0.30, 0.32, 0.35, 0.37, 0.40, 0.42, 0.45, 0.48, 0.50, 0.52, 0.55, 0.57, 0.60, 0.62, 0.65, 0.68, 0.70, 0.72, 0.75, 0.78, 0.80, 0.82, 0.85, 0.88, 0.90, 0.92, 0.95]
SWEEP_GRID = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95]
