"""Fixed values the results depend on: word lists, lookup tables and limits.

Everything here is small and constant, so it may be inlined as literals or broadcast.
"""

from __future__ import annotations

# --- fixed values: incident types, in display order -------------------------
INCIDENT_TYPES = [
    "flood",
    "landslide",
    "storm",
    "haze",
    "forest fire",
    "earthquake",
    "sinkhole",
    "tsunami",
]
NO_INCIDENT = "none"

SEVERITIES = ["Urgent", "Warning", "Informational"]
AUTHENTICITY_LABELS = ["AUTHENTIC", "MISINFORMATION", "UNCERTAIN"]

# --- fixed values: search terms and places ----------------------------------
SEARCH_TERMS = [
    "banjir", "tanah runtuh", "ribut", "jerebu", "kebakaran hutan",
    "mendapan tanah", "gempa bumi", "tsunami",
    "flood", "landslide", "storm", "haze", "forest fire", "sinkhole", "earthquake",
]

PLACE_KEYWORDS = [
    "malaysia", "kuala lumpur", "selangor", "johor", "penang", "pulau pinang",
    "perak", "kedah", "pahang", "terengganu", "kelantan", "melaka",
    "negeri sembilan", "sabah", "sarawak", "labuan", "putrajaya", "cyberjaya",
    "langkawi", "ipoh", "alor setar", "george town", "kuantan", "kuching",
    "kota kinabalu", "bintulu", "sibu", "miri",
]

PLACE_NAMES = [
    "malaysia", "kuala lumpur", "putrajaya", "labuan",
    "johor", "kedah", "kelantan", "melaka", "negeri sembilan", "pahang",
    "pulau pinang", "penang", "perak", "perlis", "sabah", "sarawak", "selangor",
    "terengganu",
    "johor bahru", "malacca city", "alor setar", "ipoh", "kuantan", "cyberjaya",
    "langkawi", "george town", "kuala terengganu", "iskandar puteri",
    "sungai petani", "sandakan", "miri", "tawau", "butterworth", "shah alam",
    "petaling jaya", "klang", "subang jaya", "taiping", "bintulu", "sibu",
]

# --- fixed values: state -> districts ---------------------------------------
STATE_DISTRICTS = {
    "selangor": [
        "shah alam", "petaling jaya", "klang", "sepang", "gombak", "hulu langat",
        "kuala langat", "kuala selangor", "sabak bernam", "hulu selangor",
    ],
    "kuala lumpur": ["kuala lumpur", "putrajaya", "labuan"],
    "putrajaya": ["putrajaya"],
    "johor": [
        "johor bahru", "muar", "kulai", "batu pahat", "kota tinggi", "mersing",
        "pontian", "segamat", "kluang", "tangkak",
    ],
    "penang": [
        "george town", "butterworth", "balık pulau", "seberang perai", "timur laut",
        "seberang perai utara", "seberang perai tengah", "seberang perai selatan",
    ],
    "pulau pinang": [
        "george town", "butterworth", "balık pulau", "seberang perai", "timur laut",
        "seberang perai utara", "seberang perai tengah", "seberang perai selatan",
    ],
    "perak": [
        "ipoh", "kuala kangsar", "taiping", "hilir perak", "kinta", "batang padang",
        "manjung", "kerian", "larut", "matang", "selama",
    ],
    "kedah": [
        "alor setar", "sungai petani", "langkawi", "kota setar", "kuala muda",
        "kubang pasu", "yan", "pendang", "padang terap",
    ],
    "pahang": [
        "kuantan", "temerloh", "bentong", "pekan", "rompin", "lipis", "jerantut",
        "maran", "bera",
    ],
    "kelantan": [
        "kota bharu", "kuala krai", "pasir mas", "tanah merah", "machang", "bachok",
        "tumpat",
    ],
    "terengganu": [
        "kuala terengganu", "dungun", "kemaman", "marang", "besut", "setiu",
    ],
    "negeri sembilan": ["seremban", "port dickson", "jempol", "kuala pilah", "rembau"],
    "melaka": ["melaka tengah", "jasin", "alor gajah"],
    "sarawak": [
        "kuching", "miri", "sibu", "bintulu", "muka", "samarahan", "serian", "kapit",
    ],
    "sabah": [
        "kota kinabalu", "sandakan", "tawau", "lahad datu", "kudat", "ranau", "tuaran",
    ],
}

# --- fixed values: state whitelist and display names -------------------------
STATE_WHITELIST = [
    "johor", "kedah", "kelantan", "melaka", "negeri sembilan", "pahang",
    "perak", "perlis", "pulau pinang", "sabah", "sarawak", "selangor",
    "terengganu", "kuala lumpur", "labuan", "putrajaya",
]

STATE_DISPLAY = {
    "pulau pinang": "Pulau Pinang",
    "penang": "Pulau Pinang",
    "kuala lumpur": "W.P. Kuala Lumpur",
    "wp kuala lumpur": "W.P. Kuala Lumpur",
    "labuan": "W.P. Labuan",
    "putrajaya": "W.P. Putrajaya",
    "negeri sembilan": "Negeri Sembilan",
    "n sembilan": "Negeri Sembilan",
    "johor": "Johor",
    "kedah": "Kedah",
    "kelantan": "Kelantan",
    "melaka": "Melaka",
    "malacca": "Melaka",
    "pahang": "Pahang",
    "perak": "Perak",
    "perlis": "Perlis",
    "sabah": "Sabah",
    "sarawak": "Sarawak",
    "selangor": "Selangor",
    "terengganu": "Terengganu",
}
# spelling offered by the subscription form, absent from the map above
STATE_DISPLAY_EXTRA = {"melacca": "Melaka"}

# --- fixed values: bounding box ----------------------------------------------
LAT_MIN, LAT_MAX = 0.0, 8.0
LON_MIN, LON_MAX = 99.0, 120.0

# map view used when nothing is selected, and zoom levels
DEFAULT_CENTRE_LAT, DEFAULT_CENTRE_LON = 4.21, 101.69
DEFAULT_ZOOM, POINT_ZOOM = 6, 12

# --- fixed values: unknown markers -------------------------------------------
UNKNOWN_STATE = "Unknown State"
UNKNOWN_DISTRICT = "Unknown District"
UNKNOWN_TERMS = ["unknown district", "unknown state", "unknown", ""]
RANKING_UNKNOWN = ["Unknown District", "unknown district", "unknown", ""]
FILTERED_RANKING_UNKNOWN = ["Unknown District", "Unknown", "unknown district", ""]
NO_TERM = ["null", "", "none"]

# --- fixed values: how a place was found ---------------------------------------
FOUND_BY_BOTH = "gps_verified_by_ai"
FOUND_BY_TEXT = "ai_opencage_rescue"
FOUND_BY_GPS = "gps_only"
NOT_FOUND = "none"

# --- fixed values: limits -----------------------------------------------------
EVENT_GAP_HOURS = 24
ALERT_COOLDOWN_MINUTES = 60
ALERT_MAX_AGE_DAYS = 90
MAX_FOLLOWERS = 10_000
PROFESSIONAL_ACCOUNT = 2
RETRIEVAL_SIZE = 50
RANKING_SIZE = 5
GEO_MIN_CONFIDENCE = 0.3
#: Tries to locate a post, the first one included.
GEO_TRIES = 3

# --- fixed values: hazard lexicon, Malay and English -> incident type ---------
# "banjir kilat" (flash flood) is a flood while "kilat" alone (lightning) is a storm,
# so longer phrases are always tried first.
HAZARD_LEXICON = {
    "banjir kilat": "flood",
    "banjir": "flood",
    "kebanjiran": "flood",
    "flash flood": "flood",
    "flash floods": "flood",
    "flash flooding": "flood",
    "flood": "flood",
    "floods": "flood",
    "flooded": "flood",
    "flooding": "flood",
    "floodwater": "flood",
    "floodwaters": "flood",
    "rising water": "flood",
    "tanah runtuh": "landslide",
    "landslide": "landslide",
    "landslides": "landslide",
    "ribut": "storm",
    "taufan": "storm",
    "kilat": "storm",
    "lightning": "storm",
    "thunder": "storm",
    "thunderstorm": "storm",
    "thunderstorms": "storm",
    "storm": "storm",
    "storms": "storm",
    "stormy": "storm",
    "rainstorm": "storm",
    "jerebu": "haze",
    "haze": "haze",
    "kebakaran hutan": "forest fire",
    "forest fire": "forest fire",
    "forest fires": "forest fire",
    "gempa bumi": "earthquake",
    "earthquake": "earthquake",
    "earthquakes": "earthquake",
    "lohong benam": "sinkhole",
    "mendapan tanah": "sinkhole",
    "sinkhole": "sinkhole",
    "sinkholes": "sinkhole",
    "hazy": "haze",
    "tsunami": "tsunami",
    "tsunamis": "tsunami",
}
# the Malay half, used to translate hazard terms inside a text
MALAY_TERMS = {
    "banjir kilat": "flood",
    "banjir": "flood",
    "tanah runtuh": "landslide",
    "ribut": "storm",
    "taufan": "storm",
    "kilat": "storm",
    "jerebu": "haze",
    "kebakaran hutan": "forest fire",
    "gempa bumi": "earthquake",
    "lohong benam": "sinkhole",
    "mendapan tanah": "sinkhole",
}

# --- own rule set for the default labellers -----------------------------------
URGENT_TERMS = [
    "help", "trapped", "rescue", "sos", "rising fast", "life-threatening", "stranded",
    "drowning", "tolong", "terperangkap", "selamatkan", "kecemasan",
]
WARNING_TERMS = [
    "warning", "alert", "advisory", "expected", "forecast", "avoid", "caution", "risk",
    "amaran", "waspada", "berjaga-jaga",
]
OFFICIAL_TERMS = ["nadma", "jps", "metmalaysia", "bomba", "official alert"]
FIRST_HAND_TERMS = ["i am", "i saw", "we are", "my", "our", "saya", "kami", "rumah"]
DRAMATIC_TERMS = [
    "sinking", "totally flooded", "viral", "hoax", "conspiracy", "end of the world",
    "everyone will die",
]
MEASURE_PATTERN = r"[0-9]+([.][0-9]+)? ?(cm|mm|km|metres?|meters?|feet|ft|kaki|am|pm)([^a-z]|$)"

# words ignored when two topics are compared
TOPIC_FILLERS = ["in", "at", "road", "jalan", "km"]

# --- fixed values: stopwords ---------------------------------------------------
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()
MALAY_STOPWORDS = ["dan", "yang", "untuk", "dari", "pada", "adalah", "ini", "itu"]

# --- fixed values: months -------------------------------------------------------
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]


def gazetteer_rows() -> list[tuple[str, str, str]]:
    """``(name, state, district)`` for every known state and district.

    A name listed under two states belongs to the last one; a district that is also a
    state name resolves to the state/district pair listed last, as in a lookup table that
    is filled in order.
    """
    table: dict[str, tuple[str, str]] = {}
    for state, districts in STATE_DISTRICTS.items():
        table[state] = (state, UNKNOWN_DISTRICT)
        for district in districts:
            table[district] = (state, district)
    return [(name, state, district) for name, (state, district) in table.items()]
