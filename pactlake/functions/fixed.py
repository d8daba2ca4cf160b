"""Word lists, patterns and tables that results depend on."""

from __future__ import annotations

# ---- fixed values: line normalisation ----
BOUNDARY_WORDS = ("All", "Any", "Each", "Either", "If", "Neither", "Notwithstanding", "Provided", "The", "This", "Upon", "When", "Where", "Whereas")

# ---- fixed values: provision types, their aliases, and the needles that infer them (first hit wins) ----
PROVISION_TYPES = (
    "parties", "effective_date", "term", "renewal", "termination", "payment", "services", "obligations", "delivery", "confidentiality",
    "intellectual_property", "liability", "indemnity", "warranties", "dispute_resolution", "governing_law", "notices", "assignment",
    "amendment", "force_majeure", "compliance", "schedules_exhibits", "signatures", "other",
)
PROVISION_ALIASES = {
    "ip": "intellectual_property",
    "intellectual_property_rights": "intellectual_property",
    "governing_law_and_dispute_resolution": "dispute_resolution",
    "disputes": "dispute_resolution",
    "notice": "notices",
    "schedule": "schedules_exhibits",
    "exhibit": "schedules_exhibits",
    "signature": "signatures",
}
PROVISION_NEEDLES = (
    ("payment", ("payment", "fee", "invoice", "pay ", "paid", "amount", "usd", "price")),
    ("effective_date", ("effective date", "commencement date", "start date")),
    ("term", ("contract term", "expiration", "end date", "remain in effect")),
    ("renewal", ("renew", "non-renewal", "successive")),
    ("termination", ("terminate", "termination", "breach", "cure")),
    ("services", ("services", "support", "maintenance", "delivery", "scope")),
    ("confidentiality", ("confidential", "non-public", "disclosed", "disclosure")),
    ("liability", ("liability", "liable", "damages", "consequential")),
    ("indemnity", ("indemn", "hold harmless")),
    ("warranties", ("warranty", "warranties", "representations")),
    ("governing_law", ("governed by", "laws of", "law of")),
    ("dispute_resolution", ("dispute", "arbitration", "mediation", "negotiation")),
    ("notices", ("notice", "notices", "registered mail", "email")),
    ("assignment", ("assign", "assignment", "transfer")),
    ("amendment", ("amend", "amendment", "modify", "modification")),
    ("force_majeure", ("force majeure", "act of god", "beyond reasonable control")),
    ("compliance", ("comply", "compliance", "law", "regulation")),
    ("intellectual_property", ("intellectual property", "ip rights", "copyright", "trademark")),
    ("parties", ("service provider", "client", "customer", "supplier")),
    ("signatures", ("signing", "signed", "signature", "authorized representative")),
    ("schedules_exhibits", ("schedule", "exhibit", "appendix", "annex")),
    ("obligations", ("shall", "must", "obligation", "responsible")),
)

# ---- fixed values: merging ----
SYNONYMS = (
    ("effective date", "start date", "commencement date"),
    ("end date", "expiration date"),
    ("confidentiality", "non-disclosure", "non disclosure"),
    ("service fee", "monthly fee", "fees"),
    ("governing law", "applicable law"),
    ("notices", "notice", "written notice", "notice requirement"),
    ("intellectual property", "intellectual property rights", "ip rights"),
    ("limitation of liability", "liability cap"),
    ("indemnification", "indemnity", "hold harmless"),
    ("force majeure", "excusable delay", "beyond reasonable control"),
    ("assignment", "assign", "transfer", "assignment restriction"),
    ("audit rights", "audit", "inspection rights", "records inspection"),
    ("deemed acceptance", "deemed accepted", "acceptance review period"),
    ("entire agreement and amendments", "entire agreement", "prior understandings", "written amendment"),
)
PAYMENT_ADJACENT = ("payment terms", "service fee", "fees", "amounts due", "invoice", "payment due date", "net 30 payment terms", "net 30")
PARTY_ROLES = ("parties", "contracting parties", "company", "client", "customer", "service provider", "marketing affiliate", "affiliate", "ma")
LAW_DISPUTE = ("governing law", "applicable law", "dispute resolution", "jurisdiction", "competent court")
INTRO_PHRASES = ("by and between", "made between", "entered into", "between:", "referred to as")
INTRO_ROLES = ("company", "client", "customer", "service provider", "affiliate", "marketing affiliate")
DISPUTE_WORDS = ("dispute", "jurisdiction", "court", "arbitration", "negotiation")

# ---- fixed values: filtering ----
BUSINESS_TYPES = ("payment", "services", "delivery", "compliance", "intellectual_property", "liability", "indemnity", "warranties", "assignment", "force_majeure", "schedules_exhibits")
RISKY_ANCHORS = {
    "net 30 payment terms": (r"\bnet\s*30\b", r"\bpayment\b.{0,80}\b30\s+days\b"),
    "technology support and upgrades": (r"\btechnology\s+(?:support|maintenance|upgrades?)\b", r"\bsupport\b.{0,120}\bupgrades?\b"),
    "technology description": (r"\btechnology\s+description\b", r"\bproducts?\s+approved\s+for\s+sale\b", r"\btechnology\b.{0,120}\b(?:platform|content|products?)\b"),
    "data security and access control": (r"\bdata\s+security\b", r"\bsecurity\s+incidents?\b", r"\bsafeguards?\b.{0,120}\bdata\b", r"\baccess\b.{0,120}\bauthorized\s+personnel\b"),
    "acceptance criteria": (r"\bacceptance\s+criteria\b", r"\breview\s+period\b", r"\bdeliverable\b.{0,160}\baccept", r"\breject\b.{0,120}\bdefects?\b"),
    "grant of rights": (r"\bgrants?\b.{0,160}\bright\s+to\b", r"\bright\s+to\s+(?:advertise|market|sell|distribute)\b", r"\blicense\s+grant\b"),
    "use restrictions": (r"\bnot\s+for\s+(?:remarketing|redistribution)\b", r"\binternal\s+use\b", r"\bunauthorized\s+use\b", r"\bdata\s+center\s+environment\b"),
}
GENERIC_LABEL_TOKENS = ("agreement", "contract", "clause", "terms")

# ---- fixed values: coverage rules (name, type, related, patterns, names that count as duplicates) ----
HIGH_PRECISION = (
    "parties", "agreement date", "payment terms", "late payment", "taxes", "notices", "assignment", "amendment", "indemnification",
    "force majeure", "audit rights", "entire agreement and amendments", "deemed acceptance",
)
RISKY_RULES = (
    "net 30 payment terms", "data security and access control", "acceptance criteria", "grant of rights", "use restrictions",
    "technology description", "technology support and upgrades", "sales reports", "sales records", "marketing plan and annual quota",
    "initial order commitment", "territory", "schedule pricing tiers",
)
RULES = (
    ("Parties", "parties", ("Contracting Parties", "Company", "Client", "Customer", "Service Provider", "Affiliate"),
     (r"\bby\s+and\s+between\b", r"\bmade\s+between\b", r"\bentered\s+into\b.{0,160}\bbetween\b", r"\bbetween\s*:\b"), ("Parties", "Contracting Parties")),
    ("Agreement Date", "effective_date", ("Dated", "Execution Date", "Agreement Date"),
     (r"\bdated\s*:\s*", r"\bentered\s+into\s+this\b", r"\bdate\s+of\s+(?:its\s+)?execution\b"), ()),
    ("Contract Term", "term", ("Term", "Effective Date and Term", "Expiration Date"),
     (r"\bshall\s+begin\b.{0,240}\bremain\s+in\s+effect\b", r"\bterm\s+of\s+this\s+agreement\b", r"\bexpiration\s+date\b"), ()),
    ("Renewal Clause", "renewal", ("Renewal", "Automatic Renewal", "Renewal Term"),
     (r"\bautomatic(?:ally)?\s+renew", r"\brenewal\s+term\b", r"\bnon[- ]renewal\b"), ()),
    ("Payment Terms", "payment", ("Fees", "Invoice", "Amounts Due", "Payment Due Date"),
     (r"\bpayment\s+terms\b", r"\bpay(?:ment)?\b.{0,120}\binvoice\b", r"\bamounts?\s+due\b"), ("Payment Terms", "Fees", "Amounts Due")),
    ("Net 30 Payment Terms", "payment", ("Net 30", "Schedule A Terms"),
     (r"\bnet\s*30\b", r"\bthirty\s*\(30\)\s*days\b.{0,80}\bpayment\b"), ("Net 30 Payment Terms", "Net 30")),
    ("Late Payment", "payment", ("Late Payment Charge", "Overdue Accounts", "Service Suspension"),
     (r"\blate\s+payment\b", r"\boverdue\s+accounts?\b", r"\bunpaid\b.{0,120}\bsuspension\b"), ("Late Payment", "Late Payment Charge", "Overdue Accounts")),
    ("Taxes", "payment", ("Excise Tax", "Sales Tax", "Tax Responsibility"),
     (r"\btaxes\b", r"\bexcise\b.{0,80}\bsales\b.{0,80}\btaxes\b"), ("Taxes", "Tax Responsibility")),
    ("Acceptance Criteria", "delivery", ("Acceptance", "Review Period", "Deliverable Acceptance"),
     (r"\bacceptance\s+criteria\b", r"\breview\s+period\b", r"\breject\b.{0,120}\bdefects?\b", r"\bdeliverable\b.{0,160}\baccept(?:ance|ed)\b"), ("Acceptance Criteria", "Review Period", "Deliverable Acceptance")),
    ("Data Security and Access Control", "compliance", ("Data Security", "Access Control", "Safeguards", "Security Incident Reporting"),
     (r"\bdata\s+security\b", r"\bsafeguards?\b.{0,120}\bdata\b", r"\baccess\b.{0,120}\bauthorized\s+personnel\b", r"\bsecurity\s+incidents?\b"), ("Data Security and Access Control", "Data Security", "Access Control")),
    ("Grant of Rights", "intellectual_property", ("License Grant", "Distribution Rights", "Right to Market", "Right to Sell"),
     (r"\bgrants?\b.{0,160}\bright\s+to\b", r"\bright\s+to\s+(?:advertise|market|sell|distribute)\b", r"\blicense\s+grant\b"), ("Grant of Rights", "License Grant", "Distribution Rights")),
    ("Use Restrictions", "intellectual_property", ("Unauthorized Use", "Internal Use", "Redistribution Restriction", "Data Center Restriction"),
     (r"\binternal\s+use\b", r"\bnot\s+for\s+(?:remarketing|redistribution)\b", r"\bunauthorized\s+use\b", r"\bdata\s+center\s+environment\b"), ("Use Restrictions", "Unauthorized Use", "Redistribution Restriction")),
    ("Technology Description", "schedules_exhibits", ("Technology", "Products", "Platform", "Content"),
     (r"\bproducts?\s+approved\s+for\s+sale\b", r"\btechnology\b.{0,120}\b(?:platform|content|products?)\b", r"\btechnology\s+description\b"), ("Technology Description", "Technology")),
    ("Technology Support and Upgrades", "services", ("Support", "Upgrades", "Maintenance", "Technical Support"),
     (r"\btechnology\s+maintenance\b", r"\bsupport\b.{0,120}\bupgrades?\b", r"\btechnical\s+support\b"), ("Technology Support and Upgrades", "Support and Upgrades")),
    ("Sales Reports", "obligations", ("Marketing Reports", "Forecasts", "Sales Forecasts"),
     (r"\bsales\s+reports?\b", r"\breport\s+periodically\b", r"\bsales\s+forecasts?\b"), ("Sales Reports", "Sales Forecasts")),
    ("Sales Records", "obligations", ("Records", "Books", "Audit Records"),
     (r"\bsales\s+records?\b", r"\bbooks\s+and\s+records\b", r"\bmaintain\s+records?\b"), ("Sales Records", "Audit Records")),
    ("Marketing Plan and Annual Quota", "obligations", ("Marketing Plan", "Annual Quota", "Sales Quota"),
     (r"\bannual\s+marketing\s+plan\b", r"\bannual\s+sales\s+quotas?\b", r"\bannual\s+quota\b"), ("Marketing Plan and Annual Quota", "Annual Quota", "Sales Quota")),
    ("Initial Order Commitment", "payment", ("Minimum Units", "First Six Months", "Purchase Commitment"),
     (r"\binitial\s+order\s+commitment\b", r"\bminimum\s+of\s+\d+\s+units?\b", r"\bfirst\s+six\s+months\b"), ("Initial Order Commitment", "Minimum Units")),
    ("Territory", "schedules_exhibits", ("Authorized Territory", "Resale Territory", "Schedule Territory"),
     (r"\bauthorized\s+territory\b", r"\bterritory\b.{0,120}\bschedule\b", r"\bterritory\s*:\s*"), ("Territory", "Authorized Territory", "Resale Territory")),
    ("Schedule Pricing Tiers", "schedules_exhibits", ("Pricing Tiers", "Purchase Level", "Purchase Discount", "Discount Matrix"),
     (r"\bpricing\s+(?:tiers|matrix)\b", r"\bpurchase\s+levels?\b", r"\bpurchase\s+discount\b", r"\b\d{1,3}\s*%\s+discount\b"), ("Schedule Pricing Tiers", "Pricing Tiers", "Purchase Discount")),
    ("Copyrights and Trademarks Protection", "intellectual_property", ("Copyrights", "Trademarks", "Service Marks", "Proprietary Rights"),
     (r"\bcopyrights?\b.{0,160}\btrademarks?\b", r"\bservice\s+marks\b", r"\bproprietary\s+rights\b"), ("Copyrights and Trademarks Protection", "Copyrights", "Trademarks")),
    ("Trade Secrets and Source Code", "intellectual_property", ("Trade Secrets", "Source Code", "Confidential Technology"),
     (r"\btrade\s+secrets?\b", r"\bsource\s+code\b", r"\bconfidential\s+technology\b"), ("Trade Secrets and Source Code", "Trade Secrets", "Source Code")),
    ("Confidential Information Definition", "confidentiality", ("Confidential Information", "Personal Data", "Agreement Terms"),
     (r"\bconfidential\s+information\b.{0,80}\bincludes\b", r"\bpersonally\s+identifiable\b", r"\bagreement\s+terms\b.{0,80}\bconfidential\b"), ("Confidential Information Definition",)),
    ("Warranty Disclaimer", "warranties", ("Disclaimer of Warranties", "No Warranty", "No Guarantee"),
     (r"\bdisclaims?\b.{0,120}\bwarrant(?:y|ies)\b", r"\bno\s+warranty\b", r"\bwarranty\s+disclaimer\b"), ("Warranty Disclaimer", "Disclaimer of Warranties", "No Warranty")),
    ("Liability", "liability", ("Limitation of Liability", "Liability Cap", "Consequential Damages"),
     (r"\blimitation\s+of\s+liability\b", r"\bshall\s+not\s+be\s+liable\b", r"\bconsequential\s+damages\b", r"\bliability\s+cap\b"), ("Liability", "Limitation of Liability", "Liability Cap")),
    ("Indemnification", "indemnity", ("Indemnity", "Defend", "Hold Harmless"),
     (r"\bindemnif", r"\bhold\s+harmless\b", r"\bdefend\b.{0,120}\bclaim\b"), ("Indemnification", "Indemnity")),
    ("Force Majeure", "force_majeure", ("Excusable Delay", "Beyond Reasonable Control", "Act of God"),
     (r"\bforce\s+majeure\b", r"\bbeyond\s+(?:its|their|reasonable)\s+control\b", r"\bacts?\s+of\s+god\b", r"\bexcusable\s+delay\b"), ("Force Majeure", "Excusable Delay")),
    ("Audit Rights", "obligations", ("Audit", "Inspection Rights", "Records Inspection"),
     (r"\baudit\s+rights?\b", r"\bmay\s+audit\b", r"\bright\s+to\s+(?:audit|inspect)\b", r"\bsite\s+inspect\b"), ("Audit Rights", "Audit")),
    ("Deemed Acceptance", "delivery", ("Deemed Accepted", "Acceptance Review Period", "No Rejection"),
     (r"\bdeemed\s+accept(?:ed|ance)\b", r"\baccepted\b.{0,160}\bdoes\s+not\s+reject\b", r"\bno\s+(?:specific\s+)?defect\s+rejection\b"), ("Deemed Acceptance", "Deemed Accepted", "Acceptance Review Period")),
    ("Governing Law and Dispute Resolution", "dispute_resolution", ("Governing Law", "Jurisdiction", "Dispute Resolution", "Court"),
     (r"\bgoverned\s+by\b.{0,240}\b(?:jurisdiction|court|dispute|arbitration|negotiation)\b", r"\bjurisdiction\b.{0,160}\bgoverned\s+by\b", r"\bdispute\s+resolution\b"), ("Governing Law and Dispute Resolution", "Governing Law", "Jurisdiction")),
    ("Notices", "notices", ("Notice Delivery", "Email", "Registered Mail", "Deemed Receipt"),
     (r"\bnotices?\s+(?:must|shall|under)\b", r"\bregistered\s+mail\b", r"\bdeemed\s+received\b"), ("Notices", "Notice Delivery", "Deemed Receipt")),
    ("Assignment", "assignment", ("Assign", "Transfer", "Assignment Restriction"),
     (r"\bassignment\b", r"\bmay\s+not\s+assign\b", r"\bassign\s+or\s+transfer\b"), ("Assignment", "Assignment Restriction")),
    ("Amendment", "amendment", ("Modification", "Written Amendment", "Changes"),
     (r"\bamend(?:ment|ed)?\b", r"\bmodify\b", r"\bchanges?\b.{0,80}\bin\s+writing\b"), ("Amendment", "Modification", "Written Amendment")),
    ("Entire Agreement and Amendments", "amendment", ("Entire Agreement", "Prior Understandings", "Written Amendment", "Supersedes"),
     (r"\bentire\s+(?:agreement|understanding)\b", r"\bsupersedes\b.{0,160}\bprior\b", r"\bmodification\s+or\s+amendment\b.{0,120}\bin\s+writing\b"), ("Entire Agreement and Amendments", "Entire Agreement", "Prior Understandings")),
    ("Electronic Signatures", "signatures", ("Electronic Signature", "Signature Blocks", "Authorized Representatives"),
     (r"\belectronic\s+signature", r"\bsign(?:ed|atures?)\s+electronically\b", r"\bauthorized\s+representatives?\b.{0,120}\bsign\b"), ("Electronic Signatures", "Electronic Signature", "Signature Blocks")),
    ("Post-Termination Obligations", "termination", ("Return of Materials", "Cessation of Marketing", "Post-Termination Non-Use"),
     (r"\bfollowing\s+the\s+termination\b", r"\bpost[- ]termination\b", r"\breturn\b.{0,120}\bmaterials?\b", r"\bcease\b.{0,120}\b(?:marketing|using|selling|support)\b"), ("Post-Termination Obligations", "Return of Materials", "Post-Termination Non-Use")),
    ("Permits and Legal Compliance", "compliance", ("Compliance", "Permits", "Legal Requirements", "Business Practices"),
     (r"\bcomply\b.{0,120}\b(?:laws?|regulations?|ordinances?)\b", r"\bpermits?\b.{0,120}\blegal\b", r"\bbusiness\s+practices\b"), ("Permits and Legal Compliance", "Compliance", "Business Practices")),
)

# ---- fixed values: exact evidence ----
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = MONTHS + r"\s+\d{1,2},\s+\d{4}"
ORDINAL_DATE = r"\d{1,2}\s*(?:st|nd|rd|th)?\s+day\s+of\s+" + MONTHS + r"\s+\d{4}"
NUMERIC_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
MONEY = r"(?:USD|US\$|\$|EUR|GBP|VND)\s*[\d,]+(?:\.\d+)?"
MONEY_RANGE = MONEY + r"\s*(?:to|-|and\s+above)\s*(?:USD|US\$|\$|EUR|GBP|VND)\s*[\d,]+(?:\.\d+)??"
PERCENT = r"(?:\d+(?:\.\d+)?|one(?:\s+and\s+one[-\s]half)?)\s*(?:%|percent)"
NET_TERMS = r"\bNet\s*\d+\s*(?:days?)?\b"
QUANTITY = r"(?:minimum\s+of\s+)?\d[\d,]*\s+(?:Units?|licenses?|seats?|copies?|orders?)"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PERIOD = r"(?:\d+\s*\(\d+\)|[A-Za-z]+\s*\(\d+\)|\d+|[A-Za-z]+)\s+(?:business\s+)?(?:days?|hours?|weeks?|months?|years?)"
LAW = r"laws?\s+of\s+[A-Z][A-Za-z ,.-]+"
LEGAL_VERB = (
    r"\b(shall|must|will|may|agree|agrees|include|includes|excluding|responsible|"
    r"pay|paid|purchase|ship|deliver|provide|notify|sent|approved|accepted|rejected|"
    r"terminate|renew|assign|confidential|liable|indemnify|warrant|governed|within|"
    r"commit|commits|license|grant|restrict)\b"
)
KEYWORD_STOPWORDS = ("a", "an", "and", "are", "by", "for", "from", "in", "is", "of", "on", "or", "shall", "the", "this", "to", "will", "with")
#: tokens -> patterns of the entities they ask for
ENTITY_FAMILIES = (
    (("date", "expiration", "commencement"), (DATE, ORDINAL_DATE, NUMERIC_DATE)),
    (("fee", "fees", "payment", "amount", "price", "pricing", "compensation"), (MONEY, MONEY_RANGE, PERCENT, NET_TERMS)),
    (("late", "charge", "discount", "tiers", "tier", "level"), (PERCENT, MONEY_RANGE)),
    (("quota", "commitment", "minimum", "units", "unit", "purchase"), (QUANTITY,)),
    (("notice", "notices", "contact", "email"), (EMAIL,)),
    (("term", "period", "duration", "response"), (PERIOD,)),
    (("law",), (LAW,)),
)
ENTITY_REQUIRED = (
    "amount", "commencement", "compensation", "contact", "date", "discount", "duration", "email", "expiration", "fee", "fees", "late",
    "level", "law", "notice", "notices", "payment", "period", "price", "pricing", "quota", "response", "term", "tier", "tiers", "unit", "units",
)

# ---- fixed values: evaluation ----
LABEL_STOPWORDS = ("a", "an", "and", "by", "for", "in", "of", "or", "the", "to")
TOKEN_EQUIVALENTS = {"non": "no", "venue": "jurisdiction"}
WEIGHTS = {"keyword": 0.25, "grouping": 0.20, "context": 0.25, "exact": 0.25, "page": 0.05}
MATCH_WEIGHTS = {"keyword": 0.35, "grouping": 0.20, "context": 0.20, "exact": 0.20, "page": 0.05}

# ---- fixed values: patterns of lines and headings ----
NUMBER_ALONE = r"(?U)^(?:\d+\.|\d+(?:\.\d+)+\.?|\([A-Za-z]\))$"
NUMBER_START = r"(?U)^(?:\d+(?:\.\d+)*\.?|\([A-Za-z]\))\s+\S"
LIST_MARKER = r"(?U)^(?:[-*•]|\([A-Za-z0-9]+\)|[A-Za-z]\.)\s+"
SOURCE_FOOTER = r"(?iU)^(?:\d+\s+)?Source:\s+.+$"
LEGAL_HEADING = r"(?iU)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX|ANNEX)\b"
TABLE_LIKE = r"(?U)\t|\s{2,}|\$|%|\b\d{1,3}(?:,\d{3})+\b"
SIGNATURE = r"(?iU)^(IN WITNESS WHEREOF|SIGNATURES?|SIGNED|AGREED AND ACCEPTED|ACCEPTED AND AGREED)\b"
STRUCTURE = r"(?iU)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX|ANNEX)\b"
NUMBERED = r"(?U)^(\d+\.|\d+(?:\.\d+)+\.?)\s+(\S.*)$"
BULLET = r"(?U)^(\([A-Za-z0-9]+\)|[a-z]\.)\s+\S"

# ---- fixed values: spacing of lines ----
ZERO_WIDTH = r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CUT_WORD = r"(?U)(\w)-\s*\n\s*(\w)"
LEADING_NUMBER = r"(?U)^(?:\d+(?:\.\d+)*\.?|\([A-Za-z]\))\s+"
SPACING = (
    (r"(?U)\s+([,.;:!?])", "$1"),
    (r"(?U)([;:!?])(?=\S)", "$1 "),
    (r"(?U)(?<!\d),(?=\S)(?!\d)", ", "),
    (r"(?<=[A-Za-z]{2})\.(?=[A-Z])", ". "),
    (r"(?<=[a-z])(?=(" + "|".join(BOUNDARY_WORDS) + r")\b)", " "),
)

# ---- fixed values: configuration ----
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
PROVIDERS = ("openai-compatible", "openai", "grok", "groq", "gemini")
PROVIDER_ALIASES = {"compatible": "openai-compatible", "openai-compatible-api": "openai-compatible", "xai": "grok", "google": "gemini", "google-gemini": "gemini"}
KEY_VARIABLES = {"openai-compatible": ("OPENAI_API_KEY",), "openai": ("OPENAI_API_KEY",), "grok": ("XAI_API_KEY", "GROK_API_KEY"), "groq": ("GROQ_API_KEY",), "gemini": ("GOOGLE_API_KEY", "GEMINI_API_KEY")}
SHARED_KEY = "KEYWORD_LLM_API_KEY"
#: field -> environment variable
VARIABLES = {
    "provider": "KEYWORD_LLM_PROVIDER",
    "model": "KEYWORD_LLM_MODEL",
    "max_parallel_llm_calls": "MAX_PARALLEL_LLM_CALLS",
    "max_total_llm_calls": "MAX_TOTAL_LLM_CALLS",
    "fast_exact": "KEYWORD_FAST_EXACT",
    "coverage_max_groups": "KEYWORD_COVERAGE_MAX_GROUPS",
    "coverage_mode": "KEYWORD_COVERAGE_MODE",
    "filter_groups": "KEYWORD_FILTER_LOW_CONFIDENCE_GROUPS",
}
