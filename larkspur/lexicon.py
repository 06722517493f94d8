"""Word lists and maps of the search semantics. All are fixed values."""

STOPWORDS = ["a", "an", "about", "for", "the", "to", "i", "need", "learn", "show", "me", "course", "courses", "of", "and", "in", "on", "with", "please"]
ABBREVIATIONS = {"bf": "breastfeeding", "nb": "newborn", "ppd": "postpartum depression", "pp": "postpartum"}
SYNONYMS = {
    "breast feeding": ["breastfeeding", "lactation", "nursing"], "breastfeeding": ["lactation", "nursing"], "lactation": ["breastfeeding", "nursing"],
    "new born": ["newborn", "infant", "baby care"], "newborn": ["new born", "infant", "baby care"], "post partum": ["postpartum"], "postpartum": ["post partum", "after delivery"],
    "depression": ["low mood", "mental health"], "basics": ["beginner", "foundation", "intro"], "beginner": ["basics", "introductory"], "advanced": ["expert", "specialist"],
    "tamil": ["tamizh", "thamizh"], "hindi": ["hindhi"], "c section": ["cesarean", "caesarean"],
}
TRANSLITERATIONS = {"tamizh": "tamil", "thamizh": "tamil", "thaippal": "breastfeeding", "palootal": "breastfeeding", "kulanthai": "newborn", "paramarippu": "care", "pirandha": "newborn", "piragu": "postpartum"}
DIFFICULTY = {"beginner": ["beginner", "basic", "basics", "foundation", "intro", "introductory", "starter"], "advanced": ["advanced", "expert", "specialist", "professional"], "intermediate": ["intermediate"]}
LANGUAGES = {"english": ["english", "eng"], "tamil": ["tamil", "tamizh", "thamizh"], "hindi": ["hindi", "hindhi"], "telugu": ["telugu"]}
FILLERS = ["uh", "um", "please", "actually", "basically", "like"]
WEAK_TERMS = ["advanced", "advance", "expert", "specialist", "beginner", "basic", "basics", "foundation", "intro", "introductory", "starter", "intermediate"]
ROMANIZED = {
    "garbhavastha": ["गर्भावस्था", "pregnancy"], "khatre": ["खतरे", "danger"], "sanket": ["संकेत", "signs"], "navjat": ["नवजात", "newborn"], "maa": ["माँ", "mother"], "surakshit": ["सुरक्षित", "safe"],
    "prasav": ["प्रसव", "delivery"], "rakta": ["रक्त", "blood"], "mutra": ["मूत्र", "urine"], "janch": ["जांच", "examination", "test"], "poshan": ["पोषण", "nutrition"], "paramarsh": ["परामर्श", "counselling"],
    "samajh": ["समझ", "understanding"], "mulyankan": ["मूल्यांकन", "assessment"], "navjat shishu": ["नवजात शिशु", "newborn baby"], "stanya": ["breastfeeding", "lactation"],
    "parivar niyojan": ["परिवार नियोजन", "family planning"], "uchch jokhim": ["उच्च जोखिम", "high risk"], "hrp": ["high risk pregnancy", "उच्च जोखिम गर्भावस्था"], "pph": ["post partum hemorrage", "प्रसवोत्तर रक्तस्राव"],
    "amtsl": ["active management of third stage of labour", "प्रसव के तीसरे चरण का सक्रिय प्रबंधन"], "enbc": ["essential newborn care", "नवजात शिशु देखभाल"], "kmc": ["kangaroo mother care", "कंगारू मदर केयर"],
    "anc": ["antenatal care", "गर्भावस्था देखभाल"], "iucd": ["आईयूसीडी", "intrauterine contraceptive device"], "ppiucd": ["PPIUCD", "postpartum iucd"],
    "lam": ["lactational amenorrhea method", "लैक्टेशनल एमेनोरिया विधि"], "lbw": ["low birth weight", "कम वजन नवजात"],
}
TOPICS = {
    "breastfeeding": ["breastfeeding", "lactation", "nursing"], "newborn care": ["newborn", "baby", "infant", "care"], "postpartum mental health": ["postpartum", "depression", "mood"],
    "pregnancy nutrition": ["pregnancy", "nutrition", "diet"], "infant safety": ["infant", "cpr", "safety"],
}
SEGMENTATION_HINTS = [
    "i", "a", "course", "courses", "need", "learn", "hindi", "english", "tamil", "on", "for", "family", "planning", "lam", "um", "ka", "ki", "assessment", "please", "stage", "4",
    "monitoring", "mother", "newborn", "condition", "evaluation", "enbc", "high", "risk", "pregnancy", "danger", "signs", "sign", "pph", "hrp",
]
GUIDANCE = ["Try fewer words or remove a filter", "Try the corrected query suggestion if shown", "Search by topic, for example 'lactation' or 'newborn care'"]
EXPLANATIONS = {
    "title": "Exact or normalized title match", "phrase": "Query phrase found in course content", "lexical": "Lexical BM25 match on title, tags, or description",
    "fuzzy": "Typo-tolerant fuzzy match", "semantic": "Semantic retrieval rescue", "language": "Preferred language boost applied",
}
#: Types of recordings that are taken. Fixed values.
AUDIO_TYPES = ["audio/wav", "audio/x-wav", "audio/mpeg", "audio/mp3", "audio/ogg", "audio/webm", "audio/mp4", "audio/x-m4a"]
#: Queries that should find nothing. Fixed values.
NEGATIVE_QUERIES = [
    "quantum astrophysics for toddlers", "best pizza near airport", "javascript event loop tutorial", "amazon return policy", "bollywood latest trailer", "football live score", "how to build drone engine",
    "cryptocurrency staking basics", "advanced kubernetes cluster tuning", "guitar chord progressions", "movie recommendation for horror fans", "real estate tax planning", "python dataframe merge examples",
    "vacation packing checklist", "wireless router setup", "photoshop layer masking", "gaming laptop benchmark", "air fryer recipes", "car insurance premium comparison", "graphic design portfolio tips",
]
