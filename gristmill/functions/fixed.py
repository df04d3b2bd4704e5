"""Vocabularies, rule tables and patterns that results depend on. A rule is its name and its keywords, in order."""

# --- fixed values: rule tables ---

MUST_LEVELS = [
    ("MUST", ["must", "shall", "required", "need to", "is required to", "has to", "shall not", "must not"]),
    ("SHOULD", ["should", "preferred", "recommend", "ideally"]),
    ("MAY", ["may", "optional", "can"]),
    ("INFO", ["note", "for reference", "tbd", "n/a"]),
]

CATEGORY_PREFIXES = [
    ("BIOS-", ["BIOS"]),
    ("BMC-", ["BMC"]),
    ("HOST-", ["Platform"]),
]

CATEGORY_KEYWORDS = [
    ("BIOS", ["PXE", "BBS", "SMBIOS", "headless", "USB boot", "PECI", "DIMM"]),
    ("BMC", ["IPMI", "Redfish", "SEL", "SNMP", "SOL", "iKVM", "watchdog", "BMC must", "BMC shall", "BMC is", "BMC firmware"]),
    ("Security", ["TPM", "security hardening", "chassis intrusion", "FIPS"]),
    ("Compliance", ["IEC60950", "IEC62368", "GB4943", "regulatory", "certification", "compliance", "IBM Standards", "certified compliant", "safety report", "FCC", "EMC", "IEEE1613", "PTCRB", "UL", "CE mark", "RoHS", "REACH", "EN55032", "EN55035", "CISPR", "NEBS", "GR-63", "homologation"]),
    ("Reliability", ["ALT", "HALT", "MTBF", "vibration", "shock", "package drop", "humidity", "altitude", "acoustic", "burn-in", "seismic", "thermal cycling"]),
    ("Power", ["PSU", "-48V", "Vac", "power supply", "clearance spacing"]),
    ("Thermal", ["thermal", "fan", "air flow", "air intake"]),
    ("Mechanical", ["bezel", "tray", "rail", "rack ear", "tool less", "paint", "screen print", "internal FRU", "operator access", "FRU component"]),
    ("Storage", ["NVMe", "SAS", "SATA", "M.2", "MegaRAID", "CacheVault", "RAID", "super-cap", "supercap", "cache vault"]),
    ("PCIe", ["PCIe", "x8", "x16", "NIM", "SIM", "XMC"]),
    ("Documentation", ["documentation", "schematics", "design verification", "factory test plan", "renderings", "API documentation"]),
    ("Commercial", ["price", "pricing", "quote", "lead time", "delivery", "penalty", "warranty", "quotation", "EOL", "exclusivity", "launch schedule", "Incoterms", "payment", "discount", "indemnity", "liability"]),
    ("Legal", ["license", "rights to", "redistribute", "IP", "source code", "NDA", "confidential"]),
    ("Platform", ["total memory", "management port", "1GbE", "10GbE", "RJ45", "NIC"]),
]

GLOSSARY_NOTES = ["GLOSSARY/DEFINITION", "GLOSSARY", "DEFINITION"]
DEFAULT_CATEGORY = "General"

CATEGORY_OWNERS = [
    ("BIOS", ["BIOS"]),
    ("BMC", ["BMC"]),
    ("Security", ["QA"]),
    ("Compliance", ["QA"]),
    ("Reliability", ["QA"]),
    ("Documentation", ["PM"]),
    ("Power", ["Power"]),
    ("Thermal", ["Thermal"]),
    ("Mechanical", ["ME"]),
    ("Storage/HW", ["EE/Storage"]),
    ("Storage/SW", ["SW/Storage"]),
    ("Platform", ["EE/Platform"]),
    ("Commercial", ["PM"]),
    ("Legal", ["Legal"]),
    ("Glossary", ["TBD"]),
    ("General", ["EE/Platform"]),
]

OWNER_KEYWORDS = [
    ("BIOS", ["PXE", "BBS", "SMBIOS", "headless", "USB boot", "legacy USB", "PECI", "DIMM", "serial redirection", "VT100", "Administrator Password"]),
    ("BMC", ["IPMI", "Redfish", "SEL", "SNMP", "SOL", "iKVM", "KCS", "HPM", "watchdog", "health monitoring", "POST error", "chassis intrusion", "sensor"]),
    ("QA", ["IEC60950", "GB4943", "FIPS", "ALT", "HALT", "MTBF", "reliability", "regulatory", "certification", "vibration", "shock", "acoustic", "package drop", "humidity", "altitude"]),
    ("Power", ["PSU", "-48V", "Vac", "power supply", "12V power", "voltage rails"]),
    ("Thermal", ["clearance spacing", "air flow", "air intake", "fan module", "thermal"]),
    ("ME", ["bezel", "tray", "rail", "rack ear", "hot-swap", "tool less", "screen print", "paint", "chassis"]),
    ("EE/Storage", ["NVMe", "SAS", "SATA", "M.2", "MegaRAID", "CacheVault", "super-cap", "RAID"]),
    ("SW/Storage", ["firmware", "driver", "CLI", "API", "SNMP trap", "storage software"]),
    ("EE/Platform", ["CPU", "PCH", "chipset", "DDR4", "RDIMM", "memory channel", "PCIe", "x8", "x16", "NIM", "SIM", "XMC", "option card"]),
    ("PM", ["price", "pricing", "quote", "payment", "discount", "Incoterms", "schedule", "delivery"]),
    ("Legal", ["license", "rights to", "redistribute", "IP", "source code", "escrow"]),
]

#: id, keywords, status, category, needs evidence, forbids numbers, message
REDFLAGS = [
    ("RF_GLOSSARY", ["GLOSSARY/DEFINITION", "GLOSSARY", "DEFINITION"], "AUTO_SKIP", "Glossary", None, None, "名詞解釋/縮寫定義：不進入 compliance 回覆清單"),
    ("RF_CERT", ["FIPS", "IEC60950", "GB4943", "UL listed", "CE mark", "FCC", "RoHS", "REACH", "certification", "regulatory", "homologation"], "NEED_REVIEW", None, True, None, "認證/法規：需提供認證報告或合規聲明，QA/Safety 審核"),
    ("RF_RELIABILITY", ["MTBF", "HALT", "vibration", "shock", "humidity", "altitude", "thermal cycling", "package drop", "Accelerated Life Test", " ALT "], "NEED_REVIEW", None, True, None, "可靠度/環境測試：需提供測試計畫或報告，QA/Safety 審核"),
    ("RF_PRICE", ["price", "pricing", "quote", "cost", "USD", "TWD", "payment", "discount", "Incoterms"], "NEED_REVIEW", None, None, True, "價格/付款條款：禁止自動填金額，需 PM/Sales 審核"),
    ("RF_SCHEDULE", ["lead time", "delivery", "shipment", "deadline", "penalty", "liquidated damages", "SLA"], "NEED_REVIEW", None, True, None, "交期/罰則：需 PM 審核，缺資料先標 TBD"),
    ("RF_IP", ["intellectual property", "IP rights", "license", "licensing", "redistribute", "source code", "escrow", "rights to distribute"], "NEED_REVIEW", None, True, None, "授權/IP 條款：需 Legal/PM 審核"),
    ("RF_ROADMAP", ["roadmap", "7-year", "lifecycle", "availability", "EOL", "end of life"], "NEED_REVIEW", None, True, None, "供貨年限/roadmap：需 PM/EE 與供應鏈證據"),
]
GLOSSARY_MESSAGE = "名詞解釋/縮寫定義：AUTO_SKIP"

SPEC_CATEGORIES = [
    ("CPU", ["cpu", "processor", "soc", "marvell", "amd", "intel", "arm"]),
    ("Memory", ["dram", "memory", "ram", "ddr"]),
    ("Storage", ["emmc", "ssd", "nvme", "storage", "flash", "boot"]),
    ("Network", ["ethernet", "switch", "fpga", "sfp", "rj45", "nic", "management"]),
    ("Wireless", ["wifi", "wi-fi", "lte", "5g", "wwan", "antenna", "sim", "carrier", "triband", "ieee802"]),
    ("Display", ["display", "lcd", "led", "screen", "console"]),
    ("Power", ["power", "poe", "battery", "dc", "ac", "fanless", "voltage"]),
    ("Certification", ["cert", "fips", "ptcrb", "tecc", "gcf", "fcc", "ul ", "ce mark"]),
    ("Mechanical", ["wallmount", "rackmount", "pcba", "pcie", "usb", "m.2"]),
    ("Thermal", ["temperature", "thermal", "operating temp"]),
    ("Performance", ["performance", "throughput", "gbps", "mbps"]),
]

CATEGORY_CORRECTIONS = [
    ("Compliance", ["FCC", "EMC", "IEC", "IEEE1613", "PTCRB", "UL", "CE", "RoHS", "REACH", "EN55032", "EN55035", "CISPR", "IEC62368", "IEC60950", "NEBS", "GR-63", "safety", "regulatory", "homologation", "certification"]),
    ("Commercial", ["warranty", "quotation", "EOL", "exclusivity", "launch schedule", "NDA", "indemnity", "liability", "penalty", "payment", "Incoterms", "pricing", "discount", "delivery"]),
    ("Reliability", ["shock", "vibration", "burn-in", "seismic", "HALT", "ALT", "MTBF", "humidity", "thermal cycling", "altitude", "acoustic"]),
]

RISK_TAGS = {
    "RF_CERT": "CERT", "RF_RELIABILITY": "RELIABILITY", "RF_PRICE": "PRICING", "RF_SCHEDULE": "SCHEDULE", "RF_IP": "IP/LEGAL",
    "RF_ROADMAP": "LIFECYCLE", "RF_GLOSSARY": "GLOSSARY", "SECURITY_TPM_COMPLIANCE": "CERT",
    "SUBJECTIVE_ACCEPTANCE": "ACCEPTANCE", "FIELD_SERVICE_IMPACT": "SERVICEABILITY", "ORPHAN_SUBITEM": "ORPHAN_SUBITEM",
}
MESSAGE_PREFIXES = [("認證/法規", "CERT"), ("可靠度/環境", "RELIABILITY"), ("價格/付款", "PRICING"), ("交期/罰則", "SCHEDULE"), ("授權/IP", "IP/LEGAL"), ("供貨年限", "LIFECYCLE"), ("名詞解釋", "GLOSSARY")]
TAG_PATTERNS = [
    (r"\b(certif\w*|regulatory|FIPS|IEC6\w*|GB4943|UL\b|CE mark|FCC\b|RoHS|REACH|homologat\w*|safety report|EN55\w*|CISPR|NEBS|PTCRB)", "CERT"),
    (r"\b(reliab\w*|MTBF|HALT\b|ALT\b|vibrat\w*|shock|humid\w*|thermal.cycl\w*|burn.in|seismic|altitude)", "RELIABILITY"),
    (r"\b(price|pricing|cost\b|USD|TWD|payment|discount|Incoterms|quotat\w*)", "PRICING"),
    (r"\b(lead.time|deliver\w*|shipment|deadline|penalty|liquidated|SLA\b)", "SCHEDULE"),
    (r"\b(intellectual property|IP rights|licens\w*|escrow|source code|redistribut\w*)", "IP/LEGAL"),
    (r"\b(roadmap|lifecycle|EOL\b|end of life|7.year|availab\w*)", "LIFECYCLE"),
]
RISK_NOTES = {
    "CERT": "Requires certification evidence or compliance declaration",
    "RELIABILITY": "Requires test plan or reliability report",
    "PRICING": "Pricing/payment terms — PM/Sales review required",
    "SCHEDULE": "Lead time/penalty clause — PM review required",
    "IP/LEGAL": "IP/licensing terms — Legal review required",
    "LIFECYCLE": "Lifecycle/EOL clause — PM/supply chain review required",
    "GLOSSARY": "Definition/abbreviation — informational only",
    "ACCEPTANCE": "Subjective acceptance criteria — clarify with customer",
    "SERVICEABILITY": "Field service impact — confirm replacement policy",
    "ORPHAN_SUBITEM": "Possible orphan sub-item; verify parent context in original document",
}

BUCKETS = [
    ("Hardware", ["hardware", "platform", "cpu", "memory", "pcie", "storage", "storage/hw", "network", "wireless", "lan", "display", "interface", "i/o", "io", "power", "tpm", "performance"]),
    ("Software", ["software", "bios", "bmc", "firmware", "driver", "os", "management", "storage/sw"]),
    ("Mechanical", ["mechanical", "serviceability", "chassis", "bezel", "dimension", "label", "packaging"]),
    ("Regulatory", ["regulatory", "emc", "safety", "ce", "fcc", "rohs", "certification", "compliance", "security", "legal"]),
    ("Environmental", ["environmental", "temperature", "thermal", "humidity", "shock", "vibration", "reliability"]),
    ("Others", ["general", "commercial", "documentation", "unknown"]),
]

PRIORITIES = [
    ("MUST", ["M", "MUST", "MANDATORY", "H", "HIGH"]),
    ("SHOULD", ["S", "SHOULD", "MEDIUM"]),
    ("MAY", ["L", "LOW", "MAY", "O", "OPTIONAL"]),
]

# --- fixed values: vocabularies and orders ---

STATUSES = ["NEW", "NEED_REVIEW", "INTERNAL_ALIGN", "ASK_CUSTOMER", "READY_FOR_RESPONSE", "CLOSED", "PENDING", "AUTO_SKIP"]
RESPONSE_STATUSES = ["COMPLIANT", "PARTIAL", "NON-COMPLIANT"]
PROGRESS_STATUSES = ["COMPLIANT", "PARTIAL", "NON-COMPLIANT", "NEW", "PENDING", "NEED_REVIEW"]
STATUS_RANK = {"NEED_REVIEW": 0, "INTERNAL_ALIGN": 1, "ASK_CUSTOMER": 2, "NEW": 3, "READY_FOR_RESPONSE": 4, "CLOSED": 5, "AUTO_SKIP": 6}
MUST_RANK = {"MUST": 0, "SHOULD": 1, "MAY": 2, "INFO": 3}
CATEGORY_RANK = {"Compliance": 0, "Reliability": 1, "Security": 2, "Platform": 3, "BMC": 4, "BIOS": 5, "Storage": 6, "PCIe": 7, "Power": 8, "Thermal": 9, "Mechanical": 10, "General": 99}
EXTENSION_ORDER = ["docx", "doc", "xlsx", "xls", "pdf", "md", "txt"]
SHEETS = ["Compliance Matrix", "By_Category_Summary", "3. Hardware", "4. Software", "5. Mechanical", "6. Regulatory", "7. Environmental", "8. Others", "Glossary", "Notes", "Skipped", "Excluded", "Field Guide"]
REWRITE_REASONS = ["already_complete", "fragment_to_standalone", "qa_answer_to_requirement", "ambiguous_needs_review", "no_rewrite"]
PROVIDER_SECONDS = {"internal": 20.0, "openai": 0.6}
DEFAULT_SECONDS, WARN_SECONDS, STRONG_SECONDS, SAVED_SECONDS = 5.0, 3600, 14400, 1.5
PARSER_VERSION = PROMPT_VERSION = "1.0.0"
RUN_FILES = ["manifest.json", "requirements.json", "requirements_enriched.json", "requirements_clean.json", "requirements_review.xlsx", "compliance_matrix.xlsx"]
RUN_OUTPUTS = ["requirements.json", "requirements_enriched.json", "requirements_clean.json", "compliance_matrix.xlsx"]
TEXT_EXTENSIONS = ["txt", "md", "rst", "csv", "tsv", "json", "jsonl", "yaml", "yml", "html", "htm", "xml"]
SKIPPED_FOLDERS = ["__pycache__", ".git", ".venv", "venv"]
#: req id, requirement, notes, confidence, file, chunk, section, table, row
MOCK_ITEMS = [
    ("BIOS-4", "PXE boot support from management I/O ports. PXE activated by pressing 'L' on serial console during BIOS boot.", "", 0.9, None, None, "Table 3", "BIOS Requirements", "BIOS 4"),
    ("HOST-36", "FIPS 140-2 Level 2 compliance. Visual opacity shall restrict observation through vents.", "", 0.9, None, None, "4.3", "Table 1: Host System Requirements", "HOST 36"),
    ("AUTO-mock-1-001", "RAM: Random Access Memory", "GLOSSARY/DEFINITION", 0.6, "mock.docx", 1, None, None, None),
]
MOCK_NOTE = "No-AI mock extraction for UI flow testing only"
DERIVED_NOTE = "Derived from spec table — no explicit shall/must"

#: header, explanation, editable, internal only
GUIDE = [
    ("Req ID", "需求編號，系統自動產生，用於追蹤與回覆對應。", "No", "No"),
    ("Priority", "需求優先級或重要性，用於協助排序與處理。", "Yes", "No"),
    ("Category", "需求分類，例如硬體、軟體、文件、測試或法規等。", "Yes", "No"),
    ("Responsible Team", "負責回覆或處理此需求的內部團隊。", "Yes", "Yes"),
    ("Stakeholder", "相關單位或利害關係人，供內部協作追蹤。", "Yes", "Yes"),
    ("Compliance Status", "我方對此需求的符合狀態，例如 Compliant、Partial、Gap 或 TBD。", "Yes", "No"),
    ("PM Reviewed Requirement", "PM 確認後的正式需求文字，建議作為回覆與追蹤基準。", "Yes", "No"),
    ("Customer Requirement (Original)", "客戶原始需求文字，用於追溯來源與比對。", "No", "No"),
    ("Our Response", "我方針對該需求的正式回覆內容。", "Yes", "No"),
    ("Gap / Notes", "若無法完全符合，請說明差異、限制、風險或待確認事項。", "Yes", "No"),
    ("Evidence", "佐證資料、文件連結、測試結果或規格依據。", "Yes", "No"),
    ("Risk Tags", "風險標籤，協助標示時程、技術、成本、法規或客戶風險。", "Yes", "Yes"),
    ("Source", "需求來源，例如檔名、頁次、章節或原始資料位置。", "No", "Yes"),
    ("AI Parsed Requirement", "AI 整理後的需求文字，僅供內部 review 與追溯參考。", "No", "Yes"),
    ("AI Rewrite Status", "AI 改寫或整理原因/狀態，僅供內部 review 參考。", "No", "Yes"),
    ("AI Confidence", "AI 對整理結果的信心分數，僅供內部判斷是否需要人工複核。", "No", "Yes"),
    ("PM AI Review Status", "PM 對 AI 整理結果的複核狀態，僅供內部流程追蹤。", "Yes", "Yes"),
]
GUIDE_NOTES = {"internal": "內部欄位，請勿提供給客戶。", "editable": "PM 可編輯。", "fixed": "系統產生，建議勿手動修改。"}

# --- fixed values: patterns ---

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
PURE_DATE = rf"^\s*(?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}}|\d{{1,2}}[\s\-/](?:{MONTHS})[a-z]*[\s\-/]\d{{2,4}}|(?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{2,4}})\s*$"
EMAIL_ONLY = r"^\s*[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\s*$"
CONTACT = r"^\s*[A-Z][A-Za-z\s,.\-']*?<\s*[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\s*>\s*$"
TICK_OR_LABEL = r"^\s*(?:[✓✔✕✖✗✘×√]+|Y|N|YES|NO|N/A|NA|TBD|TBC|TBA|N\.A\.|NIL|Y/N|N/Y)\s*$"
UPPER_ABBREVIATION = r"^\s*[A-Z]{1,4}\s*$"
COUNTRY_MARK = r"^\s*(?:Argentina|Brazil|Mexico|China|India|Korea|Japan|Taiwan|USA|EU|UK|Germany|France|Australia|Canada|Russia|Israel|Singapore|Indonesia|Vietnam|Thailand)\s+(?:S-Mark|INMETRO|CCC|BIS|KC|VCCI|BSMI|FCC|CE|UL|RoHS|REACH|RCM|MIC|NCC)\s*$"
REVISION_LOG = r"^\s*(?:(?:schedule|forecast|specification|spec|status|design|review|version|requirement)(?:\s*&\s*\w+)?\s+(?:updated|modified|approved|reviewed|locked|finalized|completed|added|removed|frozen)|(?:updated|modified|reviewed|approved|created)\s+by\s+|rev(?:ision)?\s*[:#]?\s*\d|owner\s*[:#]\s*[A-Z])"
SINGLE_NAME = r"^\s*[A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)?\s*$"
ORPHAN_MARKER = r"^\s*(?:\(?[a-z]\)|\d+[\.\)]|[ivxIVX]{1,4}\.|[\-•*◦●·]|[a-z]\.)\s+"
REQUIREMENT_VERB = r"\b(shall|must|required|obligation|deliverable)\b"
MODAL_VERB = r"\b(must|shall|required|conform|comply|should|will|need|support|provide|ensure|enable|allow|implement|include|have|be capable|capable of)\b"
PART_NUMBER = r"^[A-Z0-9][-A-Z0-9\s\.]{0,25}$"
BARE_NUMBER = r"^[\d]+(\.\d+)?\s*(%|GB|MB|TB|GHz|MHz|V|W|A|mm|kg|lbs?|pcs?|ea)?$"
DEFINITION_LINE = r"^[A-Z0-9][A-Z0-9 \-/]{1,15}\s*:\s*.+"
DEFINITION_START = r"^[A-Za-z0-9][A-Za-z0-9\-\+\s]{0,20}:\s+\S+"
TABLE_ID = r"^(HOST|BMC|BIOS|BIOS-BMC|PCIe|STORAGE|PWR)-\d+$"
ROW_EVIDENCE = r"\[ROW_ID\s*=\s*([A-Za-z0-9_\-]+)\]"
PROMPT_TRACES = r"(falls under RF_\w+|per redflag|which indicates|implies potential risk|Evidence required \(per redflag\)\.\s*)"
FILE_EXTENSION = r"\.(docx|doc|xlsx|xls|pdf|txt|md)$"
MOCK_KEYWORD = r"\b(shall|must|required|support|comply|requirement|should)\b"
LIST_LINE = r"^\s*(?:\d+(?:\.\d+)*[\.)]|[A-Za-z][\.)]|[-*])\s+\S+"
ROW_IDS = [(r"\b(HOST|BIOS|BMC)\s*(\d+)\b", ""), (r"\bREQ[-_ ]?(\d+)\b", "REQ"), (r"\bSR[-_ ]?(\d+(\.\d+)+)\b", "SR"), (r"\bR[-_ ]?(\d+(\.\d+)+)\b", "R"), (r"\bSEC[-_ ]?(\d+)\b", "SEC"), (r"\bITEM\s*(\d+)\b", "ITEM")]
SECTION_VERB = r"\b(shall|must|required|support|provide)\b"
TOKENS = [
    r"\b\d+(?:\.\d+)?\s*(?:GB|MB|TB|G|M|K|GHz|MHz|kHz|Hz|V|W|A|mm|cm|inch|in|kg|lbs?|°C|°F|RU|U|core|cores|pin|pins|ohm|Ω|bps|kbps|Mbps|Gbps|Tbps|x|X)\b",
    r"\b\d+(?:\.\d+)?\b",
    r"\b(?:v|V)?\d+(?:\.\d+){1,3}\b|\b[A-Z]{2,}[\-]?\d+[A-Z0-9\-]*\b",
    r"\b(?:FCC|CE\s+mark|RoHS|REACH|UL|CSA|FIPS(?:\s*1\d{2})?(?:\s*Level\s*\d)?|IEC\s*\d+|IEEE\s*\d+|DDR[1-9]|PCIe\s*[1-9](?:\.\d)?|TPM\s*[1-9](?:\.\d)?|IPMI|Redfish|HBA|NVMe|SATA(?:III|II)?|SAS|M\.2|SFP\+?|RJ-?45|BASE-T|GBASE-T|GbE)\b",
]
TOKENS_IGNORE_CASE = [True, False, False, True]
CHECKLIST = {"label": "requirement|description|model|specification|item|feature", "comply": "comply|compliance|compliant", "ref": "ref|id|#|srs|section", "priority": "priority|level|must|importance", "note": "partial|clarif|comment|note|remark"}
PROGRESS = {
    "chunk": r"^\[(?:PROGRESS|SKIP)\]\s+(\S+)\s+chunk\s+(\d+)/(\d+)\b",
    "enrich": r"^\[PROGRESS\]\s+enrich\s+item\s+(\d+)/(\d+)(?:\s+req_id=(\S+))?\s*$",
    "chunks_total": r"^\[INFO\]\s+(\S+):\s+(\d+)\s+chunks\s*$",
    "retry": r"^\[WARN\]\s+LLM\s+(?:call failed\s+\(attempt\s+|enrich\s+attempt\s+)(\d+)/(\d+).*?->\s*sleep\s+(\d+(?:\.\d+)?)\s*s",
    "item": r"^\s*\[(\d+)/(\d+)\]\s+(\S+)",
}
