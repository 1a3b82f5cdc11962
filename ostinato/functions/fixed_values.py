"""Patterns, word lists and constants whose exact text decides the results.

Everything here is data.  The order of each list matters: the first match wins.
"""

# --- catalogue numbers: (pattern, prefix), case-insensitive -------------------------------
CATALOG_NUMBER_PATTERNS = [
    (r"\bBWV\s*(\d+[a-z]?)", "BWV"),
    (r"\bS\.\s*(\d+)", "BWV"),
    (r"\bOp(?:us)?\.?\s*(\d+(?:\s*[Nn]o\.?\s*\d+)?[a-z]?)", "Op."),
    (r"\bK\.?\s*(\d+[a-z]?)", "K."),
    (r"\bKV\.?\s*(\d+[a-z]?)", "K."),
    (r"\bH(?:ob)?\.?\s*([IVXLCDM]+[:/]\d+)", "Hob."),
    (r"\bD\.?\s*(\d+[a-z]?)", "D."),
    (r"\bRV\.?\s*(\d+[a-z]?)", "RV"),
    (r"\bB\.?\s*(\d+[a-z]?)", "B."),
    (r"\bWq\.?\s*(\d+)", "Wq."),
    (r"\bNo\.?\s*(\d+)", "No."),
]

# --- work types: known titles first ---------------------------------------------------------
KNOWN_TITLES = [
    (r"quattro stagioni", "Concerto"),
    (r"vier jahreszeiten", "Concerto"),
    (r"cuatro estaciones", "Concerto"),
    (r"quatres? saisons", "Concerto"),
    (r"four seasons", "Concerto"),
    (r"jahreszeiten", "Oratorio"),
    (r"messias", "Oratorio"),
    (r"mesías", "Oratorio"),
    (r"messie", "Oratorio"),
    (r"zauberflöte", "Opera"),
    (r"flauta mágica", "Opera"),
    (r"flûte enchantée", "Opera"),
    (r"brandenburgische konzerte", "Concerto"),
    (r"conciertos de brandemburgo", "Concerto"),
    (r"wassermusik", "Suite"),
    (r"música acuática", "Suite"),
    (r"musique pour les feux", "Suite"),
    (r"goldberg.?variationen", "Variation"),
    (r"variaciones goldberg", "Variation"),
    (r"cimento dell.?armonia", "Concerto"),
    (r"la mer(?!\s+/)", "Tone Poem"),
    (r"iberia", "Suite"),
    (r"préludes", "Prelude"),
    (r"nocturnes", "Nocturne"),
    (r"études", "Etude"),
    (r"images(?!\s+/)", "Suite"),
]

# --- work types: general patterns -----------------------------------------------------------
WORK_TYPE_PATTERNS = [
    ("Symphony", [r"\bSymphon(?:y|ie)\b", r"\bSinfoni[ae]\b"]),
    ("Concerto", [r"\bConcert(?:o|i|os)\b", r"\bKonzert[e]?\b", r"\bConcert[s]?\b(?!\s+pour)"]),
    ("Overture", [r"\bOverture\b", r"\bOuvertüre\b", r"\bObertura\b"]),
    ("Suite", [r"\bSuite\b"]),
    ("Serenade", [r"\bSerenade\b", r"\bSerenata\b"]),
    ("Divertimento", [r"\bDivertimento\b"]),
    ("Tone Poem", [r"\bTone Poem\b", r"\bSymphonic Poem\b", r"\bPoema Sinfónico\b"]),
    ("String Quartet", [r"\bString Quartet\b", r"\bStreichquartett\b", r"\bQuatuor à cordes\b",
                        r"\bCuarteto de cuerdas\b"]),
    ("Piano Trio", [r"\bPiano Trio\b", r"\bTrio (?:pour|with) Piano\b"]),
    ("String Quintet", [r"\bString Quintet\b", r"\bQuintett\b"]),
    ("Piano Quartet", [r"\bPiano Quartet\b"]),
    ("Quartet", [r"\bQuartet\b", r"\bQuartett\b", r"\bQuatuor\b", r"\bCuarteto\b"]),
    ("Trio", [r"\bTrio\b"]),
    ("Sonata", [r"\bSonat[ae]\b"]),
    ("Prelude", [r"\bPr[eé]ludes?\b", r"\bPräludium\b", r"\bPreludio\b"]),
    ("Fugue", [r"\bFugue\b", r"\bFuga\b"]),
    ("Toccata", [r"\bToccata\b"]),
    ("Variation", [r"\bVariations?\b", r"\bVariationen\b", r"\bVariaciones\b"]),
    ("Etude", [r"\b[EÉ]tudes?\b", r"\bStudy\b", r"\bEstudio\b"]),
    ("Nocturne", [r"\bNocturnes?\b", r"\bNotturno\b"]),
    ("Waltz", [r"\bWaltz\b", r"\bValse\b", r"\bWalzer\b"]),
    ("Mazurka", [r"\bMazurka\b"]),
    ("Polonaise", [r"\bPolonaise\b", r"\bPolonesa\b"]),
    ("Impromptu", [r"\bImpromptu\b"]),
    ("Fantasia", [r"\bFantasi[ae]\b", r"\bFantasy\b", r"\bFantasía\b"]),
    ("Ballade", [r"\bBallade\b", r"\bBalada\b"]),
    ("Intermezzo", [r"\bIntermezzo\b"]),
    ("Mass", [r"\bMass\b", r"\bMess[ae]\b", r"\bMissa\b"]),
    ("Requiem", [r"\bRequiem\b", r"\bRéquiem\b"]),
    ("Cantata", [r"\bCantata\b", r"\bKantate\b"]),
    ("Oratorio", [r"\bOratorio\b"]),
    ("Opera", [r"\bOpera\b", r"\bÓpera\b", r"\bOper\b"]),
    ("Motet", [r"\bMotet\b", r"\bMotetto\b"]),
    ("Passion", [r"\bPassion\b"]),
    ("Magnificat", [r"\bMagnificat\b"]),
    ("Gloria", [r"\bGloria\b"]),
    ("Stabat Mater", [r"\bStabat Mater\b"]),
    ("Te Deum", [r"\bTe Deum\b"]),
    ("Song", [r"\bLied(?:er)?\b", r"\bSong\b", r"\bCanción\b", r"\bChanson\b"]),
    ("Hymn", [r"\bHymn\b", r"\bHimno\b"]),
    ("Psalm", [r"\bPsalm\b", r"\bSalmo\b", r"\bPsaume\b"]),
    ("Choral", [r"\bChoral\b", r"\bChorale\b"]),
    ("Concertino", [r"\bConcertino\b"]),
    ("Capriccio", [r"\bCapriccio\b"]),
    ("Rhapsody", [r"\bRhapsod(?:y|ie)\b", r"\bRapsodia\b"]),
    ("Scherzo", [r"\bScherzo\b"]),
    ("March", [r"\bMarch\b", r"\bMarsch\b", r"\bMarcha\b"]),
    ("Dance", [r"\bDance\b", r"\bTanz\b", r"\bDanza\b"]),
    ("Rondo", [r"\bRondo\b", r"\bRondó\b"]),
    ("Movement", [r"\bMovement\b", r"\bSatz\b", r"\bMovimiento\b"]),
]

# --- keys -------------------------------------------------------------------------------------
KEY_GERMAN = r"\b([A-Ga-g])-([Dd]ur|[Mm]oll)\b"
KEY_STANDARD = r"\b([A-G](?:[#♯]|[b♭]|-sharp|-flat)?)\s*((?:major|minor|maj|min|dur|moll|M|m))\b"
KEY_STANDARD_STRICT = r"\b([A-G](?:[#♯]|[b♭]|-sharp|-flat)?)\s*((?:major|minor|dur|moll))\b"
KEY_SHORT_MAJOR = r"\bin\s+([A-G](?:[#♯b♭])?)\s*(?:,|\s+[A-Z]|$)"
KEY_SHORT_MINOR = r"\bin\s+([a-g](?:[#♯b♭])?)\s*(?:,|\s+[A-Z]|$)"
KEY_IN_TITLE = r"in ([A-G][#b]? (?:major|minor))"
SHARP_FORMS = ["#", "♯", "-sharp"]
FLAT_FORMS = ["b", "♭", "-flat"]

# --- periods: (name, first year inclusive, end year exclusive) --------------------------------
PERIODS = [
    ("Medieval", None, 1400),
    ("Renaissance", 1400, 1600),
    ("Baroque", 1600, 1750),
    ("Classical", 1750, 1820),
    ("Romantic", 1820, 1910),
    ("Modern", 1910, 2000),
    ("Contemporary", 2000, None),
]
ACTIVE_AGE = 40

# --- circle of fifths ---------------------------------------------------------------------------
CIRCLE_OF_FIFTHS = {
    "C major": 0, "G major": 1, "D major": 2, "A major": 3, "E major": 4, "B major": 5,
    "F# major": 6, "C# major": 7, "Ab major": 8, "Eb major": 9, "Bb major": 10, "F major": 11,
    "A minor": 0, "E minor": 1, "B minor": 2, "F# minor": 3, "C# minor": 4, "G# minor": 5,
    "D# minor": 6, "A# minor": 7, "F minor": 8, "C minor": 9, "G minor": 10, "D minor": 11,
}

# --- catalogue flags of the feature vector, case-insensitive --------------------------------------
CATALOG_FLAGS = {
    "opus": r"\b(?:op\.?|opus)\s*(\d+)",
    "bwv": r"\bBWV\s*(\d+)",
    "k": r"\bK\.?\s*(\d+)",
    "hob": r"\bHob\.?\s*([IVX]+:\d+)",
    "d": r"\bD\.?\s*(\d+)",
    "rv": r"\bRV\s*(\d+)",
    "woo": r"\bWoO\s*(\d+)",
    "hwv": r"\bHWV\s*(\d+)",
}

# --- feature weights --------------------------------------------------------------------------------
FEATURE_WEIGHTS = {
    "composer": 5.0,
    "period": 3.0,
    "work_type": 2.0,
    "key": 1.0,
    "tags": 2.5,
    "catalog": 0.5,
}

# --- key to mood words ---------------------------------------------------------------------------------
KEY_MOODS = {
    "C major": "bright cheerful simple pure innocent straightforward",
    "C# major": "brilliant passionate intense",
    "Db major": "brilliant passionate intense",
    "D major": "triumphant festive brilliant joyful celebratory",
    "Eb major": "heroic noble majestic dignified grand",
    "E major": "radiant warm luminous hopeful",
    "F major": "pastoral calm peaceful gentle serene natural",
    "F# major": "dreamy ethereal mystical",
    "Gb major": "dreamy ethereal mystical",
    "G major": "joyful energetic lively playful spirited",
    "Ab major": "tender loving gentle warm",
    "A major": "confident bright optimistic",
    "Bb major": "noble heroic majestic powerful",
    "B major": "brilliant harsh intense",
    "C minor": "dark tragic serious dramatic ominous",
    "C# minor": "passionate intense emotional",
    "D minor": "melancholic serious solemn reflective somber",
    "Eb minor": "sad anxious troubled",
    "E minor": "sad lonely contemplative moody introspective wistful",
    "F minor": "dark brooding melancholic depressing",
    "F# minor": "sad mysterious somber",
    "G minor": "serious melancholic pensive sad",
    "G# minor": "dark depressing tragic",
    "Ab minor": "dark depressing tragic",
    "A minor": "melancholic tender sad gentle moody reflective",
    "Bb minor": "dark tragic horrific",
    "B minor": "lonely sad isolated contemplative",
}
MINOR_MOODS = "melancholic contemplative moody introspective"
MAJOR_MOODS = "bright cheerful uplifting optimistic"

# --- query keyword to expansion words ---------------------------------------------------------------------
QUERY_EXPANSIONS = {
    "studying": "calm focused minimal instrumental moderate-tempo no-vocals ambient concentration",
    "working out": "energetic high-energy fast-tempo motivating powerful rhythmic vigorous",
    "relaxing": "calm peaceful serene gentle slow-tempo soothing tranquil",
    "dinner party": "elegant sophisticated moderate-tempo not-too-dramatic pleasant background",
    "morning": "gentle awakening bright moderate-tempo uplifting fresh",
    "evening": "calm reflective gentle peaceful settling",
    "sleeping": "calm peaceful slow very-quiet gentle soothing lullaby",
    "reading": "calm quiet minimal instrumental gentle background ambient",
    "meditation": "calm peaceful slow minimal serene contemplative",
    "cooking": "pleasant moderate-tempo uplifting cheerful light",
    "happy": "joyful cheerful uplifting bright optimistic",
    "sad": "melancholic sorrowful tragic dark contemplative",
    "moody": "melancholic introspective contemplative moody brooding",
    "energetic": "vibrant lively dynamic spirited animated",
    "calm": "peaceful serene tranquil gentle soothing",
    "dramatic": "intense powerful emotional passionate theatrical",
    "romantic": "tender loving passionate intimate emotional",
    "dark": "ominous brooding somber tragic",
    "bright": "cheerful radiant luminous joyful",
    "contemplative": "reflective meditative introspective thoughtful",
    "triumphant": "victorious celebratory majestic powerful",
    "rainy": "melancholic calm reflective gentle moody",
    "sunny": "bright cheerful radiant joyful uplifting",
    "cloudy": "contemplative moody subdued gentle",
    "winter": "cold contemplative intimate quiet",
    "spring": "fresh awakening uplifting bright gentle",
    "summer": "bright warm energetic joyful",
    "autumn": "reflective melancholic warm contemplative",
    "main character": "triumphant confident bold dramatic powerful heroic grand majestic",
    "villain": "dark dramatic ominous powerful intense menacing",
    "goofy": "playful lighthearted cheerful whimsical bright humorous",
    "silly": "playful lighthearted cheerful bright whimsical",
    "vibing": "relaxed chill peaceful calm flowing smooth",
    "chill": "calm relaxed peaceful easy-going mellow",
    "hype": "energetic exciting powerful dynamic vigorous",
    "cozy": "warm intimate peaceful gentle comforting",
    "aesthetic": "beautiful elegant atmospheric dreamy ethereal",
    "sad girl": "melancholic emotional tender introspective gentle sorrowful",
    "badass": "powerful bold intense confident dramatic strong",
    "epic": "grand majestic powerful dramatic triumphant heroic",
    "spicy": "passionate intense dramatic fiery energetic",
    "elegant": "sophisticated refined graceful beautiful gentle",
}

# --- description text ------------------------------------------------------------------------------------
DESCRIPTION_REPEATS = {"composer": 3, "period": 2, "work_type": 2, "key_mood": 2, "tags": 3}
HINT_BWV = "Baroque era counterpoint"
HINT_K = "Classical era elegance"
HINT_OPUS = "structured composition"
HINT_D = "Romantic lyricism"

# --- words that make a tag a character tag in explanations --------------------------------------------------
CHARACTER_WORDS = [
    "dramatic", "lyrical", "peaceful", "intense", "gentle", "energetic", "calm", "passionate",
    "melancholic", "bright", "dark", "triumphant", "romantic", "playful", "somber",
]

# --- tag taxonomy ----------------------------------------------------------------------------------------
TAXONOMY = {
    "mood": [
        "melancholic", "joyful", "dramatic", "peaceful", "energetic", "introspective", "triumphant",
        "somber", "playful", "majestic", "tender", "passionate", "mysterious", "serene", "agitated",
        "tragic", "heroic", "nostalgic", "contemplative", "dark", "bright", "gentle", "intense",
        "spiritual", "romantic", "whimsical", "lighthearted", "humorous", "cheerful",
    ],
    "character": [
        "lyrical", "virtuosic", "bold", "delicate", "powerful", "intimate", "grand", "light",
        "expressive", "technical", "elegant", "refined", "rustic", "sophisticated", "ornate",
        "simple", "complex", "flowing", "angular", "graceful",
    ],
    "tempo": ["very-slow", "slow", "moderate", "fast", "very-fast", "varied-tempo"],
    "instrumentation": [
        "solo-piano", "solo-violin", "solo-cello", "solo-voice", "string-quartet", "piano-trio",
        "string-quintet", "chamber-ensemble", "full-orchestra", "piano-and-orchestra",
        "voice-and-piano", "choir", "organ", "solo-winds", "brass-ensemble", "mixed-ensemble",
        "orchestral-strings", "woodwind-ensemble",
    ],
    "form": [
        "sonata-form", "theme-and-variations", "rondo", "fugue", "suite", "free-form",
        "single-movement", "multi-movement", "concerto-form", "symphony", "dance-form", "prelude",
        "etude",
    ],
    "complexity": ["beginner-friendly", "intermediate", "advanced", "virtuosic"],
    "popularity": ["famous", "well-known", "repertoire-staple", "lesser-known", "obscure"],
    "period": [
        "baroque", "classical", "romantic", "modern", "contemporary", "renaissance", "early-music",
        "20th-century",
    ],
}

# --- title patterns of playful works, and the tags they suggest ----------------------------------------------
PLAYFUL_PATTERNS = {
    "scherzo": ["playful", "energetic"],
    "humoreske": ["humorous", "playful"],
    "humoresque": ["humorous", "playful"],
    "children": ["lighthearted", "playful"],
    "minuet": ["playful", "elegant"],
    "polka": ["playful", "cheerful"],
    "galop": ["playful", "energetic"],
    "gigue": ["playful", "energetic"],
    "toy": ["playful", "whimsical"],
    "carnival": ["playful", "whimsical"],
    "joke": ["humorous", "playful"],
    "jest": ["humorous", "playful"],
}
PLAYFUL_TAGS = ["playful", "whimsical", "humorous", "cheerful", "lighthearted"]

# --- catalogue prefix to composer id, used when no name is found in a title -----------------------------------
CATALOG_COMPOSERS = {
    "bwv": "24f1766e-9635-4d58-a4d4-9413f9f98a4c",
    "rv": "ad79836d-9849-44df-8789-180bbc823f3c",
    "k.": "b972f589-fb0e-474e-b64a-803b0364fa75",
    "d.": "f91e3a88-24ee-4563-8963-fab73d2765ed",
}

# --- data issues ------------------------------------------------------------------------------------------
UUID_TITLE = r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
GENERIC_TITLE = r"Unknown|Untitled|Unnamed"

# --- mood queries with the features expected in their results -------------------------------------------------
MOOD_QUERIES = [
    ("moody and contemplative", ["minor", "slow", "melancholic", "introspective"]),
    ("bright and cheerful", ["major", "joyful", "uplifting"]),
    ("dark and dramatic", ["minor", "tragic", "dramatic", "ominous"]),
    ("peaceful and calm", ["calm", "peaceful", "serene", "gentle"]),
    ("energetic and lively", ["energetic", "lively", "fast", "spirited"]),
    ("studying music", ["calm", "instrumental", "minimal", "focused"]),
    ("workout music", ["energetic", "fast", "rhythmic", "powerful"]),
    ("relaxing music", ["calm", "peaceful", "slow", "soothing"]),
    ("dinner party music", ["elegant", "sophisticated", "moderate"]),
    ("morning music", ["gentle", "bright", "uplifting", "awakening"]),
    ("rainy Sunday morning", ["calm", "reflective", "gentle", "melancholic"]),
    ("romantic dinner", ["tender", "intimate", "elegant"]),
    ("triumphant celebration", ["triumphant", "celebratory", "majestic", "joyful"]),
    ("late night contemplation", ["calm", "introspective", "quiet", "reflective"]),
    ("spring awakening", ["fresh", "bright", "awakening", "uplifting"]),
    ("baroque counterpoint", ["Baroque", "counterpoint", "structured"]),
    ("romantic era drama", ["Romantic", "dramatic", "emotional", "passionate"]),
    ("classical elegance", ["Classical", "elegant", "refined", "structured"]),
    ("solo piano", ["piano", "solo", "intimate"]),
    ("full orchestra", ["orchestral", "grand", "large", "powerful"]),
    ("chamber music", ["chamber", "intimate", "small"]),
]

# --- expectation cases: name, title query, needed work type, most works of one composer, least score ------------
EXPECTATION_CASES = [
    ("baroque_concerto_similarity", "concerto", "concerto", 7, 0.05),
    ("symphony_diversity", "symphony", None, 6, 0.05),
    ("opera_recommendations", "opera", "opera", None, 0.05),
]

# --- latency limits in ms: metric -> (good up to, poor above) ------------------------------------------------------
LATENCY_LIMITS = {
    "recommendation_fetch": (1000.0, 3000.0),
    "search_fetch": (800.0, 2000.0),
    "save_action": (300.0, 1000.0),
}
DEFAULT_LATENCY_LIMITS = (1000.0, 3000.0)

# --- token prices and sizes of a tagging call ------------------------------------------------------------------------
INPUT_TOKENS_PER_WORK = 500
OUTPUT_TOKENS_PER_WORK = 200
INPUT_USD_PER_MILLION = 3.0
OUTPUT_USD_PER_MILLION = 15.0

POPULAR_QUERIES = ["moody", "studying", "relaxing", "dark academia", "cozy"]
