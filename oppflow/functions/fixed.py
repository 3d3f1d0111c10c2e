"""Word lists, patterns and thresholds that results depend on."""

# fixed values: hosts that list other organisations' announcements
AGGREGATOR_HOSTS = [
    "reliefweb.int", "devex.com", "fundsforngos.org", "wepropel.org", "app.easygrant.io", "terra-viva-grants.org", "mail.beehiiv.com", "substack.com", "opportunitydesk.org",
    "opportunitytracker.ug", "leadersoftoday.com", "undp.org", "globalgiving.org", "gestionandote.org", "lnkd.in", "linkedin.com", "startupnetworks.co.uk",
]
# fixed values: hosts on which two pages may belong to anyone
SHARED_HOSTS = ["bit.ly", "tinyurl.com", "t.co", "buff.ly", "ow.ly", "cutt.ly", "rb.gy", "is.gd", "goo.gl", "docs.google.com", "drive.google.com", "forms.gle", "forms.office.com", "fondosyconvocatorias.com.mx", "onglink.org"]
# fixed value: addresses (host and path) that say nothing about what they announce
UNINFORMATIVE_URL = r"^(?:(?:[\w-]+\.)*linkedin\.com|(?:bit\.ly|tinyurl\.com|t\.co|buff\.ly|ow\.ly|cutt\.ly|rb\.gy|is\.gd|goo\.gl))(?:/|$)"
# fixed values: capital words that name no program
GENERIC_ACRONYMS = [
    "SDG", "SDGS", "NGO", "NGOS", "CSO", "CBO", "UN", "EU", "US", "USA", "AI", "ICT", "GHG", "CO2", "COP", "HIV", "AIDS", "LGBTQ", "CEO", "CFO", "CTO", "PMO",
    "ONG", "ONGS", "OSC", "PARA", "CON", "DEL", "LOS", "LAS", "UNA", "POR", "SUS", "MAS", "QUE",
]
# fixed values: capital words that name an institution with many programs
INSTITUTION_ACRONYMS = [
    "UNICEF", "UNDP", "UNEP", "UNFPA", "UNESCO", "UNHCR", "UNIDO", "UNOPS", "UNCTAD", "UNAIDS", "UNODC", "OCHA", "OHCHR", "FAO", "WHO", "WFP", "IFAD", "ILO", "IOM", "ITU", "WIPO", "OECD", "OAS", "OEA",
    "USAID", "FCDO", "DFID", "GIZ", "AFD", "SIDA", "NORAD", "JICA", "KOICA", "DANIDA", "EIB", "EBRD", "IFC", "IDB", "CAF",
    "GEF", "GCF", "IUCN", "WWF", "CEPF", "IKI", "MIT", "NASA", "NSF", "NIH", "USDA", "NEA", "NEH", "EPA", "UKRI", "CIFF",
]
# fixed values: words of at least four letters (and shorter ones) that do not tell titles apart
TITLE_STOP = [
    "grant", "grants", "fund", "funds", "the", "a", "an", "for", "of", "to", "in", "at", "from", "program", "programme", "initiative", "award", "awards", "fellowship", "fellowships", "call", "challenge",
    "opportunity", "opportunities", "support", "project", "projects", "round", "open", "new", "special", "international", "national", "global", "small", "and", "or", "with", "by", "on", "its", "this", "that", "are", "was",
    "para", "del", "los", "las", "una", "por", "con", "sobre", "hacia", "este", "esta", "accion", "fondos",
]
# fixed values: spelled-out names and their acronyms, in order
GLOSSARY = [
    ("UNEP", r"\b(?:united nations|un) environment(?:al)? programme?\b"),
    ("GEF", r"\bglobal environment(?:al)? facility\b"),
    ("UNDP", r"\bunited nations development programme?\b"),
    ("GCF", r"\bgreen climate fund\b"),
    ("IDB", r"\binter-?american development bank\b"),
    ("IUCN", r"\binternational union for conservation of nature\b"),
    ("FAO", r"\bfood and agriculture organization\b"),
    ("IKI", r"\binternational climate initiative\b"),
]
# fixed values: words left out when titles are compared beyond their acronym
RESIDUAL_FILLER = ["the", "and", "for", "of", "to", "in", "call", "grant", "grants", "fund", "funds", "program", "programme", "programa", "initiative", "award", "awards"]
# fixed values: marks of sibling programs
VARIANT_MARKERS = ["movenow"]

# fixed values: words that do not identify a title
NAME_STOP = ["the", "of", "and", "for", "de", "la", "el", "los", "las", "y", "para", "en", "del", "fund", "fondo", "foundation", "fundacion", "fundación", "trust", "inc", "org"]
GENERIC_TITLE_WORDS = [
    "grant", "grants", "program", "programme", "programa", "programas", "call", "calls", "convocatoria", "cycle", "round", "fall", "spring", "summer", "winter", "annual", "general", "community", "communities",
    "introductory", "small", "large", "open", "application", "applications", "funding", "fellowship", "fellowships", "award", "awards", "challenge", "initiative", "opportunity", "opportunities", "fondo", "fondos",
    "new", "grantmaking", "impact", "partners", "catalyst", "stem", "k12", "apply", "now", "cohort", "prize", "prizes", "support", "capital", "seed",
]

# fixed values: places outside the region, and words that name the region or the whole world
OTHER_PLACES = [
    "africa", "ghana", "kenya", "nigeria", "ethiopia", "tanzania", "uganda", "rwanda", "mozambique", "angola", "zambia", "zimbabwe", "mali", "senegal", "cameroon", "eswatini", "swaziland", "malawi", "botswana", "namibia", "south africa",
    "kigali", "nairobi", "accra", "lagos", "addis ababa", "asia", "india", "pakistan", "bangladesh", "vietnam", "cambodia", "myanmar", "indonesia", "philippines", "china", "thailand", "nepal", "sri lanka",
    "pacific islands", "oceania", "papua new guinea", "middle east", "jordan", "lebanon", "morocco", "egypt", "tunisia", "iraq", "iran", "ukraine", "moldova", "albania", "georgia", "armenia", "azerbaijan", "balkans", "western balkans", "arctic", "antarctica",
]
REGION = r"honduras|central america|latin america|latinoam[eé]rica|am[eé]rica latina|carib|mesoam[eé]rica|centroam[eé]rica|lac\b|global|worldwide|international|developing|oda|lmic"
# fixed values: what is not an opportunity, by title or text
SCHOLARSHIP = r"\b(scholarship|beca[s]?|study grant|academic grant|travel grant|award for student|student fellowship|becas\s+para\s+estudiar|estudia en)\b"
COURSE = r"\b(curso\s+de\s|webinar\s|certificaci[oó]n[:\s]|capacitaci[oó]n\s|clase\s+de\s|online course|training course|e-learning|mooc\b)\b"
VENTURE = r"\b(venture capital|equity investment|seed funding for startup|startup equity|angel invest|vc fund)\b"
NEWS_TITLE = r"^(how |why |what |when |the \w+ making |from |brazil['’]s|china['’]s|microfinance for|financing the)\b"
CONFERENCE = r"\b(conference|summit|event|gala|forum|symposium|networking event)\b.*\b(call for|submission|abstract|speaker)\b"
OTHER_NOTICE = (
    r"\b(thank[\s-]*you|gracias\s+por\s+(participar|asistir|acompa|ser\s+parte)|workshop\s+recap|recap\s+of|resumen\s+del?\s+(taller|webinar)|(premium|pro)\s+(subscription|plan|membership)|suscripci[oó]n\s+premium|membres[ií]a\s+premium"
    r"|(strategy|fundraising|grant\s+writing)\s+course|curso\s+de\s+(recaudaci|capta|redacci)|masterclass|bootcamp|diplomado|webinar|internship|pasant[ií]a|resource\s+directory|directorio\s+(unificado|de\s+recursos)"
    r"|learning\s+(lab|sessions?)|consultanc(y|[ií]a)\s+service)\b|\(not\s+a\s+grant\)|\(paid\s+course\)"
)
NAME_ONLY = r"^(aberdeen|toyota foundation|burroughs wellcome|ernest kleinwort|convergence blended|swedish energy agency|italian agency|opec fund|global affairs canada|all good ventures|western indian ocean|dutch caribbean nature|unicef venture|international organization for migration\b|iom\b)"
NEWS_PATTERNS = [r"\bupdate\b.*\d{4}", r"\boperational update\b", r"\bsituation report\b", r"\bflash appeal\b", r"\b101:\s+an explainer\b", r"\bmonthly bulletin\b", r"\bnational society\b.*\bupdate\b"]
CALL_SIGNALS = [r"call for proposal", r"request for application", r"rfp\b", r"rfa\b", r"grant[s]?\s+(?:program|opportunity|call|fund)", r"fund[s]?\s+for\s+ngo", r"small grant", r"fellowship", r"award.*application", "convocatoria", "beca", "fondo", "oportunidad"]

# fixed values: score thresholds
SKIP_BELOW, APPLY_FROM, CONSIDER_FROM, MONITOR_FROM, MOST_SCORE = 1.5, 3.8, 3.2, 2.5, 5.0
HARD_FLAGS = ["WRONG_GEOGRAPHY", "SCHOLARSHIP_ONLY", "COURSE_NOT_GRANT", "VC_ONLY", "NEWS_ARTICLE", "CONFERENCE_NOT_GRANT", "NO_SPECIFIC_OPPORTUNITY", "INELIGIBLE_GEO", "NOT_A_GRANT"]
STALE_DAYS, STALE_DRIFT = 90, 0.5
AGING_PER_WEEK, AGING_MOST = 0.15, 1.0
NEAR_MISS_FLOOR = 2.0
SIMILAR, SIMILAR_WITH_MARKER, VERY_SIMILAR = 0.80, 0.50, 0.95

# fixed values: deadline and amount phrases, in order of trust
DATE_EN = r"([A-Za-z]+ \d{1,2},?\s*\d{4})"
DATE_ES = r"(\d{1,2}\s+de\s+[a-záéíóúü]+\s+de\s+\d{4})"
DEADLINES = [
    rf"deadline[:\s]+{DATE_EN}", rf"closes?\s+(?:on\s+)?{DATE_EN}", rf"due\s+(?:by\s+)?{DATE_EN}", rf"apply\s+by\s+{DATE_EN}", rf"submit(?:ted)?\s+(?:by\s+)?{DATE_EN}",
    rf"applications?\s+(?:due|close[ds]?)\s+(?:by\s+|on\s+)?{DATE_EN}", rf"open(?:s)?\s+through\s+{DATE_EN}", rf"fecha\s+l[ií]mite[:\s]+{DATE_ES}", rf"(?:cierre|vencimiento|cierra)[:\s]+{DATE_ES}",
    rf"convocatoria\s+(?:abierta\s+)?hasta\s+(?:el\s+)?{DATE_ES}", r"deadline[:\s]+(\d{4}-\d{2}-\d{2})", r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}/\d{1,2}/\d{4})",
]
ROLLING = r"rolling\s+(?:applications?|review|deadline|basis)|open[-\s]ended|no\s+(?:fixed\s+)?deadline|year[-\s]round|continuous(?:ly)?|ongoing|always\s+accepting|convocatoria\s+permanente|siempre\s+abierta|permanente"
AMOUNTS = [
    r"up\s+to\s+(?:USD\s*)?\$?\s*([\d,]+)()", r"\$\s*([\d,]+)\s*(?:[-–to]+\s*\$?\s*([\d,]+))?", r"(?:USD|EUR)\s*([\d,]+)\s*(?:(?:to|[-–])\s*(?:USD|EUR)?\s*([\d,]+))?", r"grants?\s+(?:of|up\s+to|from|range(?:s)?)\s+\$?\s*([\d,]+)()",
    r"award(?:ing|s)?\s+(?:up\s+to\s+)?\$?\s*([\d,]+)()", r"hasta\s+(?:USD\s*)?\$?\s*([\d.]+)()", r"m[aá]ximo[:\s]+\$?\s*([\d,]+)()", r"prize(?:\s+pool)?[:\s]+\$?\s*([\d,]+)()",
]
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# fixed values: names of regions, nearest first (mark-free), and phrases on organisations and partners
CENTRAL = ["central america", "mesoamerica", "centroamerica", "america central"]
LATIN = ["latin america", "lac", "caribbean", "america latina", "latinoamerica", "el caribe"]
WORLD = ["global", "worldwide", "international", "developing", "oda", "lmic"]
ORG_NORTHERN = r"\bingo\s+lead|\bnorthern\s+(ngo|partner)|us[-\s]based\s+org|501\(c\)|us\s+nonprofit"
ORG_YOUTH = r"youth[-\s]led|youth[-\s]run|liderada[s]?\s+por\s+j[oó]venes|organizaci[oó]n\s+juvenil"
ORG_LOCAL = r"local\s+(ngo|org|civil)|national\s+(ngo|org)|community[-\s]based|cso|organizaci[oó]n\s+local|sociedad\s+civil|ong\s+local"
ORG_SOUTHERN = r"southern\s+(ngo|org|partner)|global\s+south|pa[ií]ses\s+en\s+desarrollo"
PARTNER_LEADS = "lead partner|consortium lead|northern partner|northern ngo"
PARTNER_NEEDED = "partnership required|must partner"
PARTNER_OPTIONAL = "partnership optional|can partner|may partner"
# fixed values: words that make a text an announcement (plurals too), words that need a call to act beside them, and such calls (mark-free)
STRONG_WORDS = ["grant", "grant program", "call for proposals", "call for applications", "convocatoria", "subvencion", "subvenciones", "fellowship", "challenge fund", "request for proposals", "rfp", "eoi", "expression of interest", "fund"]
WEAK_WORDS = ["funding", "financiamiento", "fondo", "fondos", "cooperacion"]
ACTION_CUES = ["aplica", "postula", r"apply\s*now", "deadline", "plazo", r"fecha\s*limite", r"convocatoria\s*abierta", r"hasta\s*el", r"cierra\s*el", r"closes?\s*on", r"due\s*date", "solicita", "inscrib"]
# fixed value: the price line of a paid course or post
PAID_LINE = r"inversion:\s*(?:bolivia|bs\.?|\$|usd|dolares|eur|euros)"
# fixed values: hosts and the funders behind them
FUNDER_HOSTS = {
    "undp.org": "UNDP", "worldbank.org": "World Bank", "iucn.org": "IUCN", "gef.org": "GEF", "climateaction.fund": "Climate Action Fund", "unep.org": "UNEP", "eci.ox.ac.uk": "Oxford ECI", "usaid.gov": "USAID",
    "macfound.org": "MacArthur Foundation", "ciff.org": "CIFF", "wellcome.org": "Wellcome Trust", "rockefellerfoundation.org": "Rockefeller Foundation",
}
# fixed values: labels of a newsletter's fields
FIELD_LABELS = r"funding|amount|award|eligibility|description|deadline|due\s*date|link|url"
KEY_LABELS = r"deadline[:：]|funding[:：]|award[:：]"
# words without which none of DEADLINES, or of AMOUNTS, can match
DEADLINE_SIGNS = r"deadline|close|due|apply|submit|open|fecha|cierr|vencimiento|convocatoria|\d{4}-\d{2}-\d{2}|\d/\d{4}"
AMOUNT_SIGNS = r"\$|USD|EUR|up\s+to|grant|award|hasta|m[aá]ximo|prize"

# fixed values: marks of list posts by kind, in order of trust (numbers are found apart)
LIST_MARKS = [
    ("keycaps", r"(?:[0-9#*]\x{FE0F}?\x{20E3}|\x{1F51F})"),
    ("arrows", r"[➜➔➤▶►→]\x{FE0F}?"),
    ("right arrows", r"➡\x{FE0F}?"),
    ("bullets", r"[🔹🔸🔶🔷▪▫◆■●•✅☑✔]\x{FE0F}?"),
]
LIST_NUMBER = r"(?:^|\s)(\d{1,2})[.)]\s++(?=[A-ZÁÉÍÓÚÑ0-9$€£])"
LEAST_ITEM, LEAST_LIST = 20, 60
# fixed values: where a list ends and the poster's own words begin
LIST_TAIL = (
    r"\s(?:Looking for|¿?Buscas|Podr[aá]s|Explora|Sign up|Suscr[ií]b|Reg[ií]strate|Follow|S[ií]guenos|Comparte|Share|Para m[aá]s|M[aá]s info|Read more|Learn more|Visit|Visita|Don.t miss"
    r"|Know someone|Tag (?:them|a|someone)|📥|🌟|🔎|📲|📣|📢|📩|🔔|👇|⏰)|\s#[\p{L}\p{N}_]"
)
# fixed values: what an item of a list says if it is a record: an amount, a cue of a deadline, a naming word
ITEM_MONEY = r"(?i)(?:[$€£]|USD|EUR|GBP)\s?\d"
ITEM_DEADLINE = r"\b(closes?|cierra|deadline|fecha l[ií]mite|hasta el|plazo|due)\b"
ITEM_WORDS = (
    r"\b(grant|grants|fund|fondo|fondos|prize|premio|award|awards|challenge|fellowship|beca|becas|programa|program|programme|convocatoria|accelerator|acelerador|aceleradora|studio|cohort|competition|competencia"
    r"|initiative|iniciativa|call|catalyst|subvenci[oó]n)\b"
)
# fixed values: words at which a name ends and its description begins
TITLE_MONEY = r"^(?:(?:Up to|Hasta|Prizes? up to|From|Desde)\s+)?(?:[$€£]|USD|EUR|GBP)\s?[\d.,]++\s?[kKmM]?\s*[–—-]\s+"
TITLE_BLURB = (
    r"\s(?:(?:Cash prizes|Prizes|Grants|Grant funding|Funding|Fellowships|Support|Awards|Financiaci[oó]n|Apoyo)\s+(?:for|to|supporting|recognising|recognizing|helping|that|available|para|que)"
    r"|Free\s+(?:[a-z]+\s+)?(?:support|training|mentoring|mentorship|services)|Partnership opportunities|Monthly\s+micro-?grants|Opportunities\s+(?:for|to))\b"
)
TITLE_AUDIENCE = r"\s(?:For|Para|Dirigido|Open to|Supports?|Empowers?)\s|\sFunds?\s+(?!for\b|of\b|and\b|the\b|in\b|to\b|&|\()|\s\|\s|:\s"
# fixed values: units of ages, and currencies with their marks in the order in which they count
AGE_UNITS = "mo|months?|mins|min|minutes?|hrs|hr|hours?|days?|weeks?|years?|yr|m|h|d|w|y"
CURRENCIES = [("AUD", r"au\$"), ("AUD", r"a\$"), ("USD", r"us\$"), ("USD", "usd"), ("EUR", "eur"), ("EUR", "€"), ("GBP", "£"), ("GBP", "gbp"), ("USD", r"\$")]
# fixed values: deadline phrases by source (null: any), with the order of the parts of their dates (d, M, y; no y: the year of the message) and the language of their months
DATE_PATTERNS = [
    (10, r"(?i)fecha\s+l[ií]mite[:\s]+(\d{1,2}\s+de\s+[a-záéíóúü]+\s+de\s+\d{4})", 1, "dMy", "es", None),
    (11, r"(?i)(\d{1,2}\s+de\s+[a-záéíóúü]+\s+de\s+\d{4})", 1, "dMy", "es", None),
    (20, r"(?i)\b((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})", 1, "Mdy", "en", None),
    (21, r"(?i)\b(\d{1,2}\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4})", 1, "dMy", "en", None),
    (30, r"(?i)\b(\d{1,2}\s+[a-z]{3,}\s+\d{4})", 1, "dMy", "en", "portal"),
    (31, r"(?i)\b([a-z]{3,}\s+\d{1,2},?\s*\d{4})", 1, "Mdy", "en", "portal"),
    (40, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1, "yMd", "en", None),
    (50, r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)", 1, "dMy", "en", "portal"),
    (51, r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)", 1, "Mdy", "en", None),
    (60, r"(?i)(?:apply|submit(?:\s+(?:a\s+)?(?:concept\s+note|letter\s+of\s+inquiry|loi))?)\s+by\s+([a-z]+\s+\d{1,2})(?!\d)", 1, "Md", "en", "newsletter"),
]
