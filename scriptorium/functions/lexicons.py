"""Word lists, code tables and patterns. All of these are fixed values that results depend on."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

# The code blocks of scripts, in the order in which ties between them are settled.
SCRIPTS = {
    "pa": "\\x{0A00}-\\x{0A7F}", "gu": "\\x{0A80}-\\x{0AFF}", "or": "\\x{0B00}-\\x{0B7F}", "ta": "\\x{0B80}-\\x{0BFF}", "te": "\\x{0C00}-\\x{0C7F}",
    "kn": "\\x{0C80}-\\x{0CFF}", "ml": "\\x{0D00}-\\x{0D7F}", "si": "\\x{0D80}-\\x{0DFF}", "hi": "\\x{0900}-\\x{097F}", "bn": "\\x{0980}-\\x{09FF}",
}
INDIC = "\\x{0900}-\\x{0DFF}"
DEVANAGARI = "\\x{0900}-\\x{097F}"
LATIN = "A-Za-z"

# Canonical codes.
CODES = {
    "hif": "hin", "bho": "hin", "awa": "hin", "mag": "hin", "mai": "hin", "urd": "hin", "ur": "hin", "mr": "mar", "tcz": "mar", "bn": "ben", "ta": "tam",
    "te": "tel", "kn": "kan", "ml": "mal", "gu": "guj", "pa": "pan", "pnb": "pan", "or": "ori", "sd": "sin", "snd": "sin", "en": "eng", "en-us": "eng",
    "en-gb": "eng", "ido": "unknown", "io": "unknown", "jbo": "unknown", "lfn": "unknown", "vol": "unknown", "ia": "unknown", "ie": "unknown",
    "nov": "unknown", "und": "unknown", "zxx": "unknown", "mis": "unknown", "lua": "unknown", "luo": "unknown", "kde": "unknown", "kpe": "unknown",
    "kri": "unknown", "ksh": "unknown", "kua": "unknown", "ekk": "unknown", "uzn": "unknown",
}

# Display names.
INDIAN_NAMES = {
    "hi": "Hindi", "mr": "Marathi", "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "gu": "Gujarati", "pa": "Punjabi",
    "or": "Odia", "as": "Assamese", "sa": "Sanskrit", "ne": "Nepali", "si": "Sinhala", "sd": "Sindhi", "hin": "Hindi", "mar": "Marathi", "ben": "Bengali",
    "tam": "Tamil", "tel": "Telugu", "kan": "Kannada", "mal": "Malayalam", "guj": "Gujarati", "pan": "Punjabi", "ori": "Odia", "asm": "Assamese",
    "san": "Sanskrit", "nep": "Nepali", "sin": "Sinhala",
}
OTHER_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ja": "Japanese",
    "ko": "Korean", "zh": "Chinese", "ar": "Arabic", "tr": "Turkish", "pl": "Polish", "nl": "Dutch", "sv": "Swedish", "da": "Danish", "no": "Norwegian",
    "fi": "Finnish", "cs": "Czech", "hu": "Hungarian", "el": "Greek", "eng": "English", "spa": "Spanish", "fra": "French", "deu": "German",
    "ita": "Italian", "por": "Portuguese", "rus": "Russian", "jpn": "Japanese", "kor": "Korean", "zho": "Chinese", "ara": "Arabic", "tur": "Turkish",
    "cmn": "Chinese", "arb": "Arabic", "ell": "Greek",
}
OBSCURE = ("ido", "jbo", "lfn", "vol", "io", "ia", "ie", "nov", "lua", "luo", "kde", "kpe", "kri", "ksh", "kua")
ENSEMBLE_INDIAN = ("hin", "mar", "ben", "tam", "tel", "kan", "mal", "guj", "pan", "ori")

# Romanized marker words by language; a line is a group, and a word counts once in each group that has it.
MARKERS = {
    "mar": """
        ahe ahes aahe aahes ahet ahot
        khup khoop khupach
        mhanje mhanun mhanoon mhantoy
        bolat bolta bolto bolte boltes
        chukicha chukla chuk
        bhet bheta bhetla bheto
        chup choop chupchap
        tu mi me mala tula tyala tila aapan aamhi tumhi
        kashala kasa kase kay kuthay kevha
        sangu sang sanga sangtoy
        yenar yeil yete yeto
        ghari ghara gharun
        kal aaj udya
        thik thiik bara
        nako nakos
        honar hotay hota hoti hoin hoeil hoel hoil hoeen hoet
        zala zali zale zalya jhala jhali jhale
        pahije paahije pahijet pahijela
        aikla aiklay aiklas aikle aiku aikun
        la var madhye
    """,
    "hin": """
        hai hain hoon ho hoga hogi
        bahut bohot bahoot bahoth
        kar kara karte karti karo karenge
        achha accha acha achhe
        chalo chala chale chalte chalenge
        main mein mai hum tum tumhe tumhare
        mujhe mujhko hamko hamara
        kya kaise kese kyun kyon kab kaha kahan
        yaar yaara yar bhai bhaiya
        dekh dekha dekho dekhte dekhenge
        bol bola bolo bolte bolenge
        thik theek thiik
        abhi ab phir fir
        jaana jana jao jaate jayenge jaa
        aana ana aao aate aayenge
        ye yeh vo voh woh yahi wohi
        mast mazaa maja bindass kamaal zabardast
    """,
    "tam": """
        naan naa nee neengal avan aval avar avanga
        ren ran raan raal raar rom ranga raanga
        tten ten then ttu chu dhu ttom tanga ttanga
        ven veen ppen ppom vom venga ppanga vaanga
        pathukaren paathukkaren poi poren varen pannuren pannuven
        mudichiduven mudichidaren mudichitten theduren thedi
        irukku irukkum irundhuchu pannu panna po poga vaa vara
        sollu solla paaru paakka kelu saapidu
        ippo ippodhu inniki innaiku naalai nethu appuram
        romba rombha konjam koncham enna yenna epdi eppadi
        illa illai mudiyaathu vendam venda aam aama seri
        dhan dhaan than thaan nu nnu oda kuda kooda
        lendhu lerndhu kku ku la le layum
        enga yeppodhu yen evlo yaaru yaar
    """,
    "generic": """
        nahi nahin na nai nay
        tha thi the thee
        ka ki ke ko
        se sai say
        par pe
    """,
}
# Parts of words that make a language's markers count as strong.
STRONG = {
    "tam": ("naan", "naa", "ren", "ven", "tten", "poi", "pathukaren", "mudichiduven", "irukku", "ippo", "ippodhu", "romba", "illa", "illai"),
    "mar": ("kashala", "sangu", "ahe", "ahes", "aahe", "mhanje", "bhet", "nako"),
    "hin": ("hai", "hoon", "kya", "kaise", "yaar", "bahut", "mein"),
}
# English marker words.
ENGLISH_MARKERS = """
    guys let lets with continue journey really actually anyway literally
    okay ok yeah yup nope sure maybe perhaps btw omg lol lmao
    what when where which who how why whose whom
    good bad nice great awesome cool must watch bro dude man
    movie shopping market office traffic late tired break party fun
    love like want need got get going doing know think feel
    just very too so really totally completely absolutely
    this that these those here there now then today tomorrow
"""
# Words that validate a text as English.
ENGLISH_WORDS = """
    the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their
    what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than
    then now look only come its over think also back after use two how our work first well way even new want because any these give day most us is was
    are been has had were said did analyze text check test hello world example sample please thanks yes okay ok
"""

# Sentences whose character n-grams are the languages' profiles, in the order that settles ties.
PROFILE_TEXTS = {
    "mar": (
        "aaj mala late hoeil thik ahe", "tu kasa ahes mala sangu kay jhala", "mi ghari jaat ahe udya bhetnar ahe", "khup bara aahe mhanje thik ahe",
        "tu kashala jatos mi pan yenar ahe", "aaj kal udya parva sakal sandhyakal", "mala tyala tila tumhala kay pahije", "kar kara karaycha jaa ja yaa yeil",
        "honar hotay hota hoti hoeil zala zali", "mi tu tula tumhi maza mazi maze",
    ),
    "hin": (
        "main thik hoon yaar bahut mast hai", "kya kar raha hai bhai kaise ho", "tum kahan ja rahe ho abhi", "mujhe bahut achha lagta hai yaar",
        "hum sab milke chalenge phir se", "kal main market jaunga tumhe bhi", "ye bahut zabardast hai dekho toh", "kab aayega wo hamko batao na",
        "main bol raha hoon sach mein", "aaj kal phir ab ye wo woh",
    ),
    "tam": (
        "naan pathukaren nee enna panra", "ippo romba late aachu poi thongalam", "nee enga pora naanum varen da", "avan avanga kitta poi sollu",
        "ippodhu mudichiduven aprom thaan", "naan avan aval avar avanga", "pathukaren pannuren varen poren", "ippo ippodhu romba illa illai",
        "poi vaa poda thoongu thedi", "ren ran raan tten ven veen",
    ),
    "ben": (
        "ami bhalo achi tumi kemon acho", "tumi kothay jachcho ekhon", "ami market jaabo tomar sathe", "eta khub bhalo lagche amar", "tumi ki korcho ekhon bolo",
        "ami tomake bhalobashi khub", "kal ami jabo tomar bari", "eta dekho khub sundor hoyeche",
    ),
    "pan": (
        "main theek haan tusi kiven ho", "tusi kithe ja rahe ho", "main kal bazaar jaana", "eh bahut vadiya hai", "tusi ki kar rahe ho",
        "main tuhanu pyaar karda", "kal main tuhade ghar aana",
    ),
}

# Contractions in the order of replacement; ordinals.
CONTRACTIONS = (("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'ve", " have"), ("'m", " am"))
ORDINALS = {
    "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth", "6th": "sixth", "7th": "seventh", "8th": "eighth", "9th": "ninth", "10th": "tenth",
}
# Slang and what it stands for.
SLANG = {
    "tbh": "to be honest", "imo": "in my opinion", "imho": "in my humble opinion", "btw": "by the way", "fyi": "for your information",
    "afaik": "as far as i know", "lol": "laughing out loud", "lmao": "laughing my ass off", "rofl": "rolling on floor laughing", "omg": "oh my god",
    "wtf": "what the fuck", "brb": "be right back", "idk": "i dont know", "irl": "in real life", "dm": "direct message", "pm": "private message",
    "rn": "right now", "asap": "as soon as possible", "ttyl": "talk to you later", "gtg": "got to go", "nvm": "never mind", "smh": "shaking my head",
    "tho": "though", "pls": "please", "plz": "please", "thx": "thanks", "ty": "thank you", "np": "no problem", "ikr": "i know right", "jk": "just kidding",
    "yolo": "you only live once", "fomo": "fear of missing out", "bae": "before anyone else", "lit": "amazing", "salty": "upset",
    "goat": "greatest of all time", "sus": "suspicious", "lowkey": "slightly", "highkey": "very", "ngl": "not gonna lie", "fr": "for real", "ong": "on god",
    "fax": "facts", "cap": "lie", "bet": "okay", "mood": "relatable", "vibe": "feeling", "stan": "support", "simp": "overly supportive", "bc": "because",
    "b4": "before", "gr8": "great", "h8": "hate", "l8r": "later", "m8": "mate", "w8": "wait", "ur": "your", "u": "you", "r": "are", "y": "why", "c": "see",
    "k": "okay", "ok": "okay", "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "dunno": "dont know",
    "lemme": "let me", "gimme": "give me", "woulda": "would have", "coulda": "could have", "shoulda": "should have", "yaar": "friend", "bhai": "brother",
    "bro": "brother", "sis": "sister", "dude": "person", "didi": "sister", "bhaiya": "brother", "acha": "okay", "accha": "good", "theek": "okay",
    "thik": "okay", "hai": "is", "hain": "are", "nahi": "no", "nahin": "no", "haan": "yes", "han": "yes", "kya": "what", "kyu": "why", "kyun": "why",
    "kaise": "how", "kaisa": "how", "kab": "when", "kahan": "where",
}

# Profane words by language and severity; entries of several words stand after a comma.
PROFANITY = {
    "english": {
        "extreme": "fuck, fucking, motherfucker, fucker, fck, fuk, f**k, shit, bullshit, horseshit, shitty, bitch, bitches, bastard, asshole, assholes, ass, dick, dickhead, cock, pussy, cunt, "
        "damn, dammit, goddamn, hell, whore, slut, prostitute, piss, pissed",
        "moderate": "stupid, idiot, dumb, moron, fool, foolish, hate, hatred, suck, sucks, sucked, loser, losers, pathetic, worthless, crap, crappy, jerk, jerks",
        "mild": "dang, darn, heck, wtf, omfg, bloody, blimey, bugger",
    },
    "hindi": {
        "extreme": "chutiya, chutiye, chodu, lodu, lode, lund, bhenchod, behenchod, behen chod, bc, madarchod, maderchod, mc, gandu, gand, gaandu, harami, haramzada, haraamzaada, kutta, kutte, "
        "kutiya, saala, sala, चूतिया, चूतिये, चोदू, लोडू, लोड़े, लंड, भेनचोद, बहनचोद, मादरचोद, गांडू, गांड, हरामी, हरामज़ादा, कुत्ता, कुत्ते, कुतिया, साला",
        "moderate": "bewakoof, bevkoof, pagal, budhu, ullu, kamina, kameena, badtameez, बेवकूफ, पागल, बुद्धू, उल्लू, कमीना, बदतमीज़",
        "mild": "besharam, badmash, ghatiya, बेशरम, बदमाश, घटिया",
    },
    "marathi": {"extreme": "zhavadya, zhavnya, zavadya, zhav, ghaan, ghand, aaichi, aai chi, झवाड्या, झवणे, घाण, आईची", "moderate": "veda, vedya, shendi, वेडा, शेंडी"},
    "tamil": {"extreme": "punda, pundai, otha, oombu, panni, naaye, thevidiya, புண்டை, ஓத்த, ஊம்பு, பன்னி, நாயே, தேவிடியா", "moderate": "loosu, karumam, மூடு, லூசு"},
    "telugu": {"extreme": "dengu, dengey, puka, modda, gudda, lanjakoduku, lanjala, దెంగు, పూక, మొద్ద, గుద్ద, లంజ", "moderate": "erripuka, edava, erri, ఎర్రిపూక, ఎదవ"},
    "kannada": {"extreme": "thika, thikamuchko, kati, boli, kathe, ತೀಕ, ಕತ್ತೆ, ಬೋಳಿ", "moderate": "bevakoof, buddi, ಬುದ್ದಿ"},
    "punjabi": {"extreme": "bhen di, bhendi, khotya, panchod, ਭੈਣ ਦੀ, ਪੰਚੋਦ, ਖੋਤਿਆ", "moderate": "gadha, gadhe, kutta, ਗਧਾ, ਕੁੱਤਾ"},
    "gujarati": {"extreme": "lavde, lavdu, lodu, bhosdi, લવડે, લોડું, ભોસડી", "moderate": "bewakoof, nadan, બેવકૂફ, નાદાન"},
    "bengali": {"extreme": "choda, chudi, madarchod, magir pola, চোদা, চুদি, মাগির পোলা, মাদারচোদ", "moderate": "buddhu, gadha, boka, বুদ্ধু, গাধা, বোকা"},
    "malayalam": {"extreme": "myre, myran, kunna, punda, thayoli, മൈര്, കുണ്ണ, പുണ്ട, തായോളി", "moderate": "patti, pattikaran, പട്ടി"},
}


def profane(languages: Sequence[str] | None = None) -> dict[str, list[str]]:
    """The words of each severity in some languages, by default in all."""
    chosen = [PROFANITY[x] for x in (languages or PROFANITY)]
    return {level: sorted({w for words in chosen for w in words.get(level, "").split(", ") if w}) for level in ("extreme", "moderate", "mild")}


# Terms and patterns of the domains.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₪": "ILS", "₦": "NGN", "₨": "PKR", "Rs": "INR", "Rs.": "INR"}
FINANCIAL_TERMS = (
    "bull market", "bear market", "dividend", "equity", "stock", "bond", "portfolio", "investment", "capital", "liquidity", "volatility", "market cap",
    "p/e ratio", "roi", "rsi", "interest rate", "apr", "loan", "mortgage", "deposit", "withdrawal", "transfer", "balance", "overdraft", "credit", "buy",
    "sell", "trade", "bid", "ask", "spread", "volume", "option", "future", "derivative", "hedge", "arbitrage", "profit", "loss", "revenue", "earnings",
    "ebitda", "cash flow", "debt", "asset", "liability", "margin", "yield", "return",
)
AMOUNT = r"(?i)([₹$€£¥₽₩₪₦₨]|Rs\.?|INR|USD|EUR|GBP)\s*([\d,]+\.?\d*)(?:\s*(thousand|million|billion|trillion|lakh|crore|K|M|B|T)\b)?"
PERCENT = r"(\d+\.?\d*)\s*%"
DATES = {
    "iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "us": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "eu": r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
    "written": r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
    "indian": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
}
TIMES = {"24h": r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "12h": r"(?i)\b\d{1,2}:\d{2}\s*(?:AM|PM)\b"}
RELATIVE = {
    "days": r"(?i)\b(?:yesterday|today|tomorrow|day before yesterday|day after tomorrow)\b",
    "relative": r"(?i)\b(?:last|next|this)\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    "ago": r"(?i)\b\d+\s+(?:day|week|month|year)s?\s+ago\b",
    "in": r"(?i)\bin\s+\d+\s+(?:day|week|month|year)s?\b",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SCIENTIFIC = r"\b\d+\.?\d*[eE][+-]?\d+\b"
UNITS = r"\b\d+\.?\d*\s*(?:km|m|cm|mm|kg|g|mg|L|mL|s|ms|Hz|kHz|MHz|GHz|MB|GB|TB|KB|Mbps|Gbps|V|A|W|°C|°F|K|Pa|kPa|MPa)\b"
KEYWORDS = (
    "if", "else", "for", "while", "return", "function", "def", "class", "import", "from", "try", "catch", "except", "finally", "async", "await", "const",
    "let", "var", "public", "private", "static", "void", "int", "float", "string", "bool", "array", "list", "dict", "map",
)
TECHNICAL = {
    "programming": (
        "algorithm", "data structure", "api", "database", "frontend", "backend", "server", "client", "http", "rest", "json", "xml", "debugging", "testing",
        "deployment", "git", "version control",
    ),
    "ai_ml": (
        "machine learning", "deep learning", "neural network", "ai", "model", "training", "inference", "dataset", "accuracy", "loss", "gradient",
        "backpropagation", "transformer", "lstm", "cnn",
    ),
    "engineering": ("voltage", "current", "resistance", "circuit", "transistor", "frequency", "amplitude", "signal", "noise", "filter", "amplifier"),
    "science": ("hypothesis", "experiment", "theory", "data", "analysis", "measurement", "error", "precision", "accuracy", "validation"),
}

RESOURCES = Path(__file__).parent.parent / "resources"


@lru_cache(maxsize=None)
def dictionary(lang: str) -> dict[str, str]:
    """Romanized words of a language and their native spelling: fixed values, one to a line in ``resources``. Other tables are read from files."""
    code = {"hi": "hin", "mr": "mar", "bn": "ben", "ta": "tam", "te": "tel", "pa": "pan"}.get(lang, lang)
    path = RESOURCES / f"romanized_{code}.csv"
    if not path.exists():
        return {}
    with path.open(encoding="utf-8", newline="") as f:
        return {row["roman"]: row["native"] for row in csv.DictReader(f)}


HINDI = dictionary("hin")


def groups(text: str) -> list[list[str]]:
    """The words of each line."""
    return [line.split() for line in text.strip().splitlines()]


def by_weight(text: str) -> dict[int, list[str]]:
    """Words by the number of groups that have them."""
    count: dict[str, int] = {}
    for group in groups(text):
        for word in set(group):
            count[word] = count.get(word, 0) + 1
    return {n: sorted(w for w, k in count.items() if k == n) for n in sorted(set(count.values()))}
