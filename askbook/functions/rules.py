"""The word lists and patterns that decide what a post says.

All of them must be these for results to agree. Patterns are written for case-insensitive, Unicode-aware search unless their
name ends in _EXACT.
"""

from __future__ import annotations

# Markets.
HOME_EXCLUDED = [r"\bRM\s*\$?\s*\d", r"\bMYR\b", r"\b(malaysia|malaysian|johor|kuala\s*lumpur|penang)\b"]
FOREIGN_FLAG = "\U0001f1f2\U0001f1fe"
FOREIGN_CURRENCY = r"(?:\b(?:USD|HKD|EUR|GBP|AUD|THB|IDR|PHP)\b|\bUS\s*\$|\bHK\s*\$|€|£)"

# Lines and messages that are no listing.
LINE_NOISE = [
    r"(only\s+SGD?\$?\d+[/\s]*month|per\s+month|/\s*month|instal?lments?|interest\s*free|payment\s+plan|\d+\s*months?\s+via\s+\w+|\b(?:DBS|POSB|OCBC|UOB|HSBC|Maybank|Citibank|Standard\s+Chartered)\b)",
    r"(watchdistrict\.store|linktree|carousell(?:\.app)?)",
]
MESSAGE_NOISE = [
    r"(giveaway|give\s*away|win\s+(a|this)\s+\w+\s+watch|going\s+to\s+one\s+lucky|competition|contest\s+alert)",
    r"^(?:[📢🎉🎊✨\s]*(?:big\s+deal|great\s+deal|flash\s+sale|promotion|announcement)[\s!🎉🎊✨]*)$",
    r"\bthank\s+you\b.*\b(trust|support|enjoy|patronage)\b",
    r"^\s*(?:follow|subscribe|join)\s+(?:us|our|now)\s*[!📱]",
    r"\b(pinned.*message|deleted message|opening hours|operating hours|shop base)\b",
    r"^(?:[📢🕘⏰🔄\s]*(?:watch\s+district\s+update|daily\s+update|weekly\s+update|stock\s+update|new\s+arrivals?\s+update)[\s!📢🕘⏰]*)$",
    r"\b(service centre|warranty registration|repair service|servicing special)\b",
    r"\b(watch winder|watch box|watch roll|watch pouch|travel case|cuff\s*links?)\b",
    r"^\s*(?:leather strap|rubber strap|nato strap|bracelet|buckle|clasp)\b.*\$",
    r"^\s*https?://(?:vt\.)?tiktok\.com/\S+\s*$",
    r"(rate|price|pricing)\s+(on|upon)\s+(request|enquiry|inquiry)",
    r"\bSOLD\b",
    r"(download\s+\w+\s+app|unlock\s+exclusive\s+benefits|app\s+credits|watch\s+protective\s+film|watchskins|watchlab\s+servicing)",
    r"(lowest\s+(possible\s+)?price\s+guaranteed|best\s+(possible\s+)?price|unbeatable\s+value)",
]
ACCESSORY = r"\b(cuff\s*links?|desk\s*clock|watch\s*winder|wind\s*er|travel\s*pouch|watch\s*roll|watch\s*box|spring\s*bar|pen(?:cil)?\s*set|crown[-\s]?(stem|tube)|dial\s*(only|for\s*sale)|movement\s*(only|for\s*sale)|hands\s*set|crystal\s*(only|replacement))\b"
CASE_DIAMETER = r"(case\s*(?:diamet\w*|size|width)?|diamet\w*)\s*[:\s]*([12]\d|3[0-9]|4[0-5])\s*mm"
MECHANISM = r"\b(automatic|quartz|manual[\s-]?winding|mechanical|chronograph|chronometer|tourbillon|perpetual\s*calendar|moon\s*phase|caliber|calibre)\b"
TERMS = [
    r"\b\d{2,4}mm\b", r"\bref[:#.]?\s*\d", r"\bmodel\s*(no|#|number)", r"\b\d{4,6}[A-Z]{0,4}\b", r"\b(automatic|quartz|manual|mechanical)\b",
    r"\b(chronograph|chronometer|tourbillon)\b", r"\b(dial|bezel|case|movement)\b", r"\b(full set|box.*papers?|box.*cert|cert.*box)\b",
    r"\b(bnib|nib|pre-?owned|preowned|mint|unworn)\b", r"\b(new.*arrival|brand new)\b",
]

# Prices.
LABELLED_BARE = r"\bprice[ds]?\b\s*(?:at|:|-)?[\s\S]{0,12}?(\d{4,6})(?!\d)"
MASKED = r"(?:SGD?|USD|RM|MYR|\$|S\$)\s*\d+x{1,3}[\d,]*"
STATED = [
    r"(?:SGD? *\$|S\$ ?|USD? *\$|US *\$|HKD? *\$|HK *\$|MYR|RM *\$?)", r"€|EUR", r"\$\s*[\d,]+(?:\.\d{2})?", r"Price[:\s]+\$?[\d,]+", r"(?:sgd|usd|hkd|myr)\s*[\d,]+",
]
RETAIL = r"\b((?:suggested|ad|authori[sz]ed)\s+retail\s+price|rrp|msrp|list\s+price|retail\s+price)\b\s*[@:]\s*\S*\d\S*(?:\s*\S*\d\S*)*"
UNPRICED = [
    r"(per\s*month|/month|monthly|instal?lments?)", r"only\s+SGD?\$?\d+",
    r"(\$?\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:off|discount|savings?)|save\s+\$?\d+|up\s+to\s+\$?\d+\s*(?:off|discount))",
]
PRICES = [
    r"Price[:\s]*\$?\s*([\d,]+(?:\.\d{2})?)", r"(?:asking|selling|our|sale)\s+price[:\s]*\$?\s*([\d,]+(?:\.\d{2})?)", r"(?:SGD? *\$)\s*([\d,]+(?:\.\d{2})?)\/?",
    r"(?:USD? *\$|US *\$|HKD? *\$|HK *\$)\s*([\d,]+(?:\.\d{2})?)\/?", r"(?:MYR|RM)\s*\$?\s*([\d,]+(?:\.\d{2})?)\/?", r"(?:EUR|€)\s*\$?\s*([\d,]+(?:\.\d{2})?)\/?",
    r"(?:USD|HKD)\s+([\d,]+(?:\.\d{2})?)\/?", r"S\$\s*([\d,]+(?:\.\d{2})?)", r"\$\s*([\d,]+(?:\.\d{2})?)\s*(?:\/|,|$|\s)",
]
THOUSANDS = r"\$?([\d]+(?:\.\d)?)\s*k\b"
DASHED = r"([\d,]{4,9})(?:\s*\/\-)"
CURRENCY_MARK = r"[$€£]|\bSGD?\b"

# Condition.
NEW = r"\b(brand\s*new|bnib|nib|new\s+old\s+stock|nos|unworn|lnib)\b"
USED = r"\b(pre[\s-]?owned|used|mint|full\s*set|complete\s*set|box\b[^\n]{0,20}\bpapers?|papers?\b[^\n]{0,20}\bbox)\b"

# Brands and their other spellings.
BRANDS = {
    "Rolex": [], "Omega": [], "Patek Philippe": [], "Tudor": [], "Cartier": [], "Breitling": [], "Audemars Piguet": [], "IWC": [], "Panerai": [], "Hublot": [], "TAG Heuer": [],
    "Seiko": [], "Grand Seiko": [], "Chopard": [], "Blancpain": [], "Breguet": [], "Vacheron Constantin": [], "Jaeger-LeCoultre": [], "Franck Muller": [],
    "A. Lange & Sohne": ["A. Lange & Söhne", "A Lange Sohne"], "Richard Mille": [], "Bell & Ross": [], "Casio": [], "Oris": [], "Zenith": [], "Piaget": [], "Longines": [], "Tissot": [],
    "Hamilton": [], "G-Shock": [], "Baltic": [], "Nomos": [], "Ulysse Nardin": [], "Girard-Perregaux": [], "Bulgari": [], "Bvlgari": [], "Corum": [], "MB&F": [],
    "FP Journe": ["F.P. Journe", "F.P Journe", "F P Journe"], "Urwerk": [], "H. Moser": ["H Moser", "Moser & Cie", "Moser & Cie."], "Sinn": [], "Swarovski": [], "Gucci": [],
    "Hermes": ["Hermès"], "Montblanc": [], "Gerald Genta": ["Gérald Genta"], "Parmigiani Fleurier": ["Parmigiani"], "Roger Dubuis": [], "Louis Moinet": [],
    "Glashutte Original": ["Glashütte Original", "Glashutte", "Glashütte"], "Chanel": [], "Louis Erard": [], "Frederique Constant": [], "Jacob & Co": ["Jacob and Co", "Jacob & Co."],
    "Baume & Mercier": ["Baume et Mercier", "Baume and Mercier"], "Carl F. Bucherer": ["Carl F Bucherer", "Carl Bucherer"], "Graham": [], "Czapek": [], "Bovet": [], "Chronoswiss": [],
    "Jaquet Droz": [], "Konstantin Chaykin": [], "Bedat": ["Bedat & Co"], "Fears": [], "Arnold & Son": ["Arnold and Son"],
}
SHORT_BRANDS_EXACT = [(r"\bAP\b", "Audemars Piguet"), (r"\bJLC\b", "Jaeger-LeCoultre"), (r"\bGS\b", "Grand Seiko"), (r"\bRM\s?\d{2,3}(?:-\d{2})?\b(?![\d,])", "Richard Mille")]

# Models by brand.
MODELS = {
    "Rolex": r"(?:Submariner|GMT.Master|Daytona|Datejust|Explorer|Yacht.Master|Day.Date|Sea.Dweller|Sky.Dweller|Air.King|Milgauss|Oyster Perpetual|OP)\b",
    "Omega": r"(?:Speedmaster|Seamaster|Planet Ocean|Aqua Terra|Constellation|De Ville|Globemaster|Moonwatch)\b",
    "Cartier": r"(?:Santos|Tank|Panthere|Ballon Bleu|Ronde|Tortue|Calibre|Drive|Pasha)\b",
    "Tudor": r"(?:Black Bay|Pelagos|Royal|1926|North Flag|Fastrider|Heritage|Prince|Ranger)\b",
    "Audemars Piguet": r"(?:Royal Oak|Millenary|Code 11|Jules Audemars|Edward Piguet|Concept)\b",
    "Patek Philippe": r"(?:Nautilus|Aquanaut|Calatrava|Grand Complications|Twenty.4|World Time)\b",
    "IWC": r"(?:Portofino|Pilot|Ingenieur|Aquatimer|Da Vinci|Portugieser|Top Gun)\b",
    "Panerai": r"(?:Luminor|Radiomir|Submersible|Mare Nostrum)\b",
    "Hublot": r"(?:Big Bang|Classic Fusion|Spirit|King Power|Square Bang|MP)\b",
    "TAG Heuer": r"(?:Carrera|Monaco|Aquaracer|Formula 1|Link|Autavia)\b",
    "Vacheron Constantin": r"(?:Overseas|Patrimony|Traditionnelle|Malte|Fiftysix|Historiques)\b",
    "Grand Seiko": r"(?:Heritage|Evolution 9|Elegance|Sport|Prospex|Presage|Astron|5 Sports|Coutura)\b",
    "Breguet": r"(?:Classique|Marine|Type XX|Tradition|Heritage|Reine de Naples|Regulator)\b",
    "A. Lange & Sohne": r"(?:Lange 1|Zeitwerk|Saxonia|Odysseus|1815|Richard Lange|Datograph)\b",
    "Breitling": r"(?:Navitimer|Superocean|Avenger|Chronomat|Premier|Top Time|Colt|Endurance Pro)\b",
    "Jaeger-LeCoultre": r"(?:Reverso|Master|Duometre|Polaris|Memovox|Atmos|Deep Sea)\b",
    "Zenith": r"(?:El Primero|Chronomaster|Defy|Pilot|Grande Class|Captain)\b",
    "Franck Muller": r"(?:Vanguard|Casablanca|Conquistador|Long Island|Crazy Hours|Master Banker)\b",
    "Chopard": r"(?:Happy Sport|Happy Diamond|Mille Miglia|L.U.C|Alpine Eagle|Imperiale)\b",
    "Ulysse Nardin": r"(?:Marine|Freak|Diver|Executive|Classico)\b",
    "Bvlgari": r"(?:Octo|Serpenti|Diagono|B.Zero1)\b",
    "Bulgari": r"(?:Octo|Serpenti|Diagono|B.Zero1)\b",
    "MB&F": r"(?:Horological Machine|Legacy Machine|Sherman|HM|LM)\b",
    "Girard-Perregaux": r"(?:Laureato|1966|Sea Hawk|Bridges)\b",
    "Bell & Ross": r"(?:BR 03|BR 05|BR V|BR X|BR S)\b",
    "H. Moser": r"(?:Endeavour|Pioneer|Streamliner|Venturer)\b",
    "Longines": r"(?:Master|HydroConquest|Conquest|Legend Diver|Spirit)\b",
    "Oris": r"(?:Aquis|Divers|Big Crown|ProPilot|Artelier)\b",
    "Nomos": r"(?:Tangente|Orion|Metro|Ludwig|Zurich|Ahoi|Club|Tetra)\b",
    "Hamilton": r"(?:Khaki|Jazzmaster|Ventura|Intra.Matic|Pan Europ)\b",
    "Tissot": r"(?:PRX|PRC|Le Locle|Gentleman|Seastar|Chemin des Tourelles)\b",
    "Piaget": r"(?:Altiplano|Polo|Limelight|Possession|Emperador)\b",
    "Sinn": r"(?:U1|U2|U50|856|104|556|144|103|EZM|Flieger)\b",
}

# References.
REF_EXACT = r"\b(\d{3,6}(?:\.\d{2,4}){0,2}[A-Z]{0,4})\b"
YEAR_EXACT = r"^(19\d{2}|20[0-3]\d)$"
BRAND_REFS_EXACT = {
    "Omega": r"\b\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{2}\.\d{3}\b",
    "Hublot": r"(?i)\b\d{3}\.[A-Z]{2}\.\d{4}\.[A-Z]{2}(?:\.[A-Z0-9]{3,6})?\b",
    "Audemars Piguet": r"(?i)\b\d{5}[A-Z]{2}\.[A-Z0-9]{2}\.[A-Z0-9]{4,8}\.\d{2}\b",
    "Panerai": r"(?i)\bPAM\s?\d{3,6}\b",
    "IWC": r"(?i)\bIW\s?\d{6}\b",
    "Cartier": r"\bW[A-Z]{0,4}\d{3,6}[A-Z0-9]{0,4}\b",
    "Breitling": r"\b[A-Z]{1,2}\d{8,11}[A-Z0-9]{0,4}\b",
}

# Attributes, in order of priority.
CASE_SIZE = r"\b(2[0-9]|3[0-9]|4[0-9]|5[0-5])(?:\.\d)?\s*mm\b"
MATERIALS = [
    ("two-tone", r"\b(two[\s-]?tone|steel\s*(?:&|and|\+|/)\s*(?:yellow|rose|white|pink)?\s*gold|half\s*gold|rolesor)\b"), ("platinum", r"\bplatinum\b|\bplat\b"),
    ("rose gold", r"\b(rose\s*gold|everose|pink\s*gold|red\s*gold)\b"), ("white gold", r"\bwhite\s*gold\b|\bwg\b"), ("yellow gold", r"\b(yellow\s*gold|full\s*gold|18k\s*gold|yg)\b"),
    ("ceramic", r"\bceramic\b|\bcerachrom\b"), ("titanium", r"\btitanium\b|\bti\b"), ("carbon", r"\b(carbon|ntpt|forged\s*carbon)\b"), ("steel", r"\b(stainless\s*steel|oystersteel|steel|ss)\b"),
]
BRACELETS = [
    ("jubilee", r"\bjubilee\b"), ("president", r"\bpresident(?:ial)?\b"), ("oysterflex", r"\boysterflex\b"), ("oyster", r"\boyster\b(?!\s*perpetual)"), ("rubber", r"\brubber\b"),
    ("leather", r"\bleather\b|\balligator\b|\bcrocodile\b"), ("nato", r"\bnato\b"), ("integrated", r"\bintegrated\s*bracelet\b"), ("bracelet", r"\bbracelet\b"), ("strap", r"\bstrap\b"),
]
FULL_SET = r"\b(full\s*set|complete\s*set|box\s*(?:&|and|\+|,)?\s*papers?|papers?\s*(?:&|and|\+|,)?\s*box|b\s*&\s*p)\b"
BOX = r"\b(?:original\s*)?box\b\s*[:\-]?\s*(yes|✓)?"
PAPERS = r"\b(?:original\s*)?(?:papers?|cert(?:ificate)?s?|warranty\s*card)\b\s*[:\-]?\s*(yes|✓)?"
WATCH_ONLY = r"\b(watch\s*only|bare\s*watch|no\s*box|without\s*box|naked)\b"
UNDER_WARRANTY = r"\b(under\s*warranty|warranty\s*(?:till|until|valid|to)\b|int(?:'l|ernational)?\s*warranty)"
WARRANTY_DATES = [r"\bwarranty\b[^\n]{0,30}?((?:19|20)\d{2})", r"\b(?:card|cert(?:ificate)?|papers?)\s*(?:dated?|date)\b[^\n]{0,20}?((?:19|20)\d{2})"]
YEARS = [
    r"\b(?:year|yr|prod(?:uction)?|manufactured)\b\s*[:\-]?\s*(?:\w{3,9}\s+)?((?:19|20)\d{2})", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+((?:19|20)\d{2})\b",
    r"\((?:[A-Za-z]{3,9}\s+)?((?:19|20)\d{2})\)",
]
STOCK_CODE = r"\b(?:our\s*ref|ref\s*(?:no|code)|stock\s*(?:no|code)|item\s*(?:no|code))\b\s*[:\-#]?\s*([A-Z]{1,3}\d{3,7})\b"
NICKNAMES = ["Pepsi", "Batman", "Batgirl", "Hulk", "Kermit", "Starbucks", "Sprite", "Root Beer", "Rootbeer", "Coke", "Bluesy", "Wimbledon", "Panda", "Reverse Panda", "Tiffany", "Smurf", "Bruce Wayne", "John Mayer", "Green Bay", "Pikachu", "Ice Blue", "Sundust", "Meteorite"]
DIAL_COLOUR = r"\b(black|white|blue|green|silver|champagne|salmon|grey|gray|brown|chocolate|choco|aubergine|rhodium|slate|olive|turquoise|mop|mother\s*of\s*pearl)\s*(?:dial|face)\b"

# Posts of several items, titles, pages.
BATCH_HEAD = r"^\s*\[\s*WATCH\s+DEALS"
BATCH_ITEM_EXACT = r"(?s)(✅\s*\(AVAILABLE\)\s*✅|❌\s*SOLD\s*❌)\s*\((\d+)\)\s*(.*?)(?=✅\s*\(AVAILABLE\)\s*✅\s*\(\d+\)|❌\s*SOLD\s*❌\s*\(\d+\)|\z)"
TITLE_SKIPPED = [r"^[📢🕘⏰🔄✅💰🔥🎉]", r"t\.me/|bit\.ly/|http", r"^(Join|Follow|Subscribe|DM|PM|WhatsApp|WA:|Telegram|Contact)\b"]
