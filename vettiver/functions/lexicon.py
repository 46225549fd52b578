"""Word lists and settings by language. They must be these for the same results; other languages have none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words that retrieval ignores.
QUESTION_TERMS = {
    "ta": "எது என்ன யார் எங்கு எங்கே எந்த எத்தனை எவ்வளவு எப்போது எப்படி ஏன் ஒரு என்று".split(),
    "hi": "क्या कौन कहाँ कहां किस कितने कितना कितनी कब कैसे क्यों एक है हैं".split(),
}
# Question words that evidence scoring ignores.
QUESTION_WORDS = {
    "ta": "எது என்ன எந்த எத்தனை யார் எங்கே எப்படி உள்ளது ஆகும் என்பது அமைந்துள்ளது அழைக்கப்படுகிறது அழைக்கப்படும் செய்யும் செய்கிறது பயன்படுத்தும் பயன்படுத்துகிறது கொண்டுள்ளது".split(),
    "hi": "क्या कौन कौनसा कौनसी कितना कितने कितनी कहाँ कैसे है हैं होता होती होते स्थित कहा जाता जाती जाते करता करती करते करने उपयोग इस्तेमाल".split(),
}
# Markers that, asked for, the evidence must have one of.
MANDATORY = {
    "ta": [["தேசிய"], ["தலைநகர"], ["ஜனாதிபதி", "குடியரசுத் தலைவர்"], ["சிவப்பு"], ["செல்சியஸ்", "°c"], ["ஃபாரன்ஹீட்", "பாரன்ஹீட்", "°f"], ["இயற்கை"], ["துணைக்கோள்"]],
    "hi": [["राष्ट्रीय"], ["राजधानी"], ["राष्ट्रपति"], ["लाल"], ["सेल्सियस", "°c"], ["फ़ारेनहाइट", "फारेनहाइट", "°f"], ["प्राकृतिक"], ["उपग्रह"]],
}
# Fixed values: "only" in questions, and what answers to it in evidence.
ONLY_ASKED = {"ta": ["ஒரே", "மட்டுமே"], "hi": ["एकमात्र", "केवल", "सिर्फ"]}
ONLY_SHOWN = {"ta": ["ஒரே", "மட்டுமே", "ஒரு", "ஒன்று", "1 ", "1."], "hi": ["एकमात्र", "केवल", "सिर्फ", "एक ", "एक ही", "1 ", "1."]}
# Superlatives, and the ordinals that contradict them.
SUPERLATIVES = {
    "ta": ["மிகப்பெரிய", "மிக பெரிய", "மிக நீளமான", "மிக உயரமான", "மிக ஆழமான", "மிக வேகமான"],
    "hi": ["सबसे बड़ा", "सबसे बड़ी", "सबसे बड़े", "सबसे लंबा", "सबसे लम्बा", "सबसे ऊंचा", "सबसे ऊँचा", "सबसे गहरा", "सबसे तेज"],
}
ORDINALS = {
    "ta": ["இரண்டாவது", "இரண்டாம்", "மூன்றாவது", "மூன்றாம்", "நான்காவது"],
    "hi": ["दूसरा", "दूसरी", "दूसरे", "द्वितीय", "तीसरा", "तीसरी", "तीसरे", "चौथा", "चौथी"],
}
# Questions with these ask for a number.
NUMBER_MARKERS = {"ta": ["எத்தனை", "எவ்வளவு"], "hi": ["कितने", "कितना", "कितनी"]}
# Endings of a Tamil word that something belongs to.
GENITIVES = ["வின்", "யின்", "த்தின்", "ட்டின்", "னின்"]
# Words that lead on from the sentence before.
CONTINUES = ["इसका ", "इसके ", "यह ", "उसका ", "அது ", "இதன் ", "இதற்கு "]
# Endings that an answer is compared without, one after the other.
ANSWER_ENDINGS = [" ஆகும்", " என்பது", " தான்", " உள்ளது", " கொண்டுள்ளது", " இருக்கிறது", " है", " हैं", " था", " थी", " थे"]
# The blocks of the two scripts, for character classes.
SCRIPTS = {"ta": "஀-௿", "hi": "ऀ-ॿ"}
# Messages without an answer.
NOT_FOUND = "NOT_FOUND"
NOT_FOUND_MESSAGES = {
    "ta": "இந்தக் கேள்விக்கான தகவல் எங்கள் தரவுத்தளத்தில் இல்லை.",
    "hi": "इस प्रश्न से जुड़ी जानकारी हमारे डेटा में उपलब्ध नहीं है।",
}
NOT_FOUND_MESSAGE = "No grounded information was found for this query."
# Prefixes that a model puts before its answer.
ENGINE_PREFIXES = ["Answer:", "answer:", "பதில்:", "উত্তর:"]
# Fixed value: what a model is asked to do.
PROMPT = "Answer the question using only the evidence.\nReturn only the shortest answer.\nDo not explain.\nIf the answer is not present, output NOT_FOUND."
# Fixed value: what an unsafe question matches.
UNSAFE = r"(?i)\bhow\s+to\s+make\s+a?\s*(bomb|explosive)\b|\bkill\s+myself\b|\bsuicide\s+method\b|\bchild\s+sexual\b"
# BM25 and fusion settings; other languages take those of "ta".
K1, B = {"ta": 0.90, "hi": 2.00}, {"ta": 0.40, "hi": 0.75}
DENSE_WEIGHT = {"ta": 2.0, "hi": 1.5}
LANE_WEIGHTS = {"dense_full": 1.00, "dense_anchor": 0.70, "sparse_full": 1.00, "sparse_anchor": 1.15}


def by_language(language: Column, values: dict, otherwise) -> Column:
    """The literal of ``values`` for the row's language, or ``otherwise``."""
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(language == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def words_of(language: Column, values: dict[str, list[str]]) -> Column:
    """The word list of the row's language as an array, empty for other languages."""
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(language == key, F.array(*map(F.lit, value)))
    return out.otherwise(F.array().cast("array<string>"))
