"""Fixed values of the domain: anchors, months, units, scripts and states. They must be as they are for right results."""

from __future__ import annotations

#: Anchor terms by field and language.
ANCHORS = {
    "survey": {
        "bn": ["দাগ নং", "দাগ নম্বর", "দাগ", "প্লট নং", "প্লট নম্বর", "দাগের"],
        "kn": ["ಸರ್ವೆ ನಂ", "ಸರ್ವೆ ಸಂಖ್ಯೆ", "ಹಿಸ್ಸಾ ನಂ", "ಸರ್ವೆ ನಂಬರ್", "ಸರ್ವೆ"],
        "mr": ["गट क्रमांक", "सर्व्हे क्र", "गट नं", "भूमापन क्रमांक", "सर्व्हे नंबर"],
        "hi": ["खसरा संख्या", "खसरा नं", "गाटा संख्या", "गाटा सं", "भूखण्ड संख्या", "खसरा"],
        "ta": ["சர்வே எண்", "புல எண்", "உட்பிரிவு எண்", "சர்வே"],
        "te": ["సర్వే నంబర్", "సర్వే నెం", "సర్వే సంఖ్య"],
        "en": ["survey no", "survey number", "khasra no", "khasra number", "plot no", "sy no", "dag no"],
    },
    "khata": {
        "bn": ["খতিয়ান নং", "খতিয়ান নম্বর", "খতিয়ান", "পর্চা নং", "পর্চা", "খতিয়ানের"],
        "kn": ["ಖಾತೆ ಸಂಖ್ಯೆ", "ಖಾತೆ ನಂ", "ಖಾತೆ ನಂಬರ್", "ಪಹಣಿ ಸಂಖ್ಯೆ"],
        "mr": ["खाते क्रमांक", "खाते नं", "खाते नंबर"],
        "hi": ["खाता संख्या", "खाता नं", "खतौनी संख्या", "खतौनी", "जमाबंदी संख्या"],
        "ta": ["பட்டா எண்", "சிட்டா எண்", "பட்டா"],
        "te": ["ఖాతా నంబర్", "పట్టాదారు పాస్ బుక్", "ఖాతా సంఖ్య"],
        "en": ["khata no", "khata number", "patta no", "khatian no", "khatoni no", "passbook no"],
    },
    "owner": {
        "bn": ["রায়তের নাম", "মালিকের নাম", "দখলদারের নাম", "স্বত্বাধিকারী", "প্রজা", "নাম"],
        "kn": ["ಮಾಲೀಕರ ಹೆಸರು", "ಖಾತೆದಾರರ ಹೆಸರು", "ಕಬ್ಜೇದಾರರ ಹೆಸರು", "ಪಟ್ಟಾದಾರರ ಹೆಸರು", "ಹೆಸರು"],
        "mr": ["भोगवटादाराचे नाव", "खातेदाराचे नाव", "जमीन मालकाचे नाव", "कब्जेदार", "नाव"],
        "hi": ["खातेदार का नाम", "भूस्वामी का नाम", "काश्तकार का नाम", "मालिक का नाम", "नाम"],
        "ta": ["பட்டாதாரர் பெயர்", "உரிமையாளர் பெயர்", "நில உரிமையாளர்", "பெயர்"],
        "te": ["పట్టాదారుని పేరు", "భూయజమాని పేరు", "రైతు పేరు", "పేరు"],
        "en": ["owner name", "pattadar name", "khatedar name", "occupant name", "raiyat name", "tenant name", "name"],
    },
    "area": {
        "bn": ["জমির পরিমাণ", "জমির মোট পরিমাণ", "মোট ক্ষেত্রফল", "পরিমাণ", "একর", "শতক", "কাঠা", "বিঘা"],
        "kn": ["ವಿಸ್ತೀರ್ಣ", "ಒಟ್ಟು ವಿಸ್ತೀರ್ಣ", "ಕ್ಷೇತ್ರ", "ಜಮೀನಿನ ವಿಸ್ತೀರ್ಣ"],
        "mr": ["एकूण क्षेत्र", "क्षेत्रफळ", "धारण जमीन क्षेत्र", "पोटखराब"],
        "hi": ["रकबा", "कुल क्षेत्रफल", "भूमि का रकबा", "क्षेत्रफल", "बीघा"],
        "ta": ["விஸ்தீரணம்", "நிலத்தின் பரப்பு", "மொத்த பரப்பு", "அளவு"],
        "te": ["విస్తీర్ణం", "మొత్తం విస్తీర్ణం", "విస్తీర్ణము"],
        "en": ["total area", "extent", "land area", "area in acres", "rakba", "area"],
    },
    "village": {
        "bn": ["মৌজা", "গ্রাম", "মৌজার নাম", "জে.এল নং", "জে.এল নম্বর", "জে.এল"],
        "kn": ["ಗ್ರಾಮ", "ಮೋಜಾ", "ಹೋಬಳಿ", "ಗ್ರಾಮದ ಹೆಸರು"],
        "mr": ["गाव", "मौजे", "सजा", "मंडळ", "गावाचे नाव"],
        "hi": ["ग्राम", "गाँव का नाम", "मौजा", "हल्का", "तहसील"],
        "ta": ["கிராமம்", "வருவாய் கிராமம்", "வட்டம்"],
        "te": ["గ్రామము", "మౌజా", "మండలం"],
        "en": ["village", "mouza", "village name", "hobli", "jl no", "tehsil"],
    },
    "registered": {
        "bn": ["রেজিস্ট্রেশনের তারিখ", "রেজিস্ট্রি তারিখ", "রেজি: তারিখ", "তারিখ", "রোজ"],
        "kn": ["ನೋಂದಣಿ ದಿನಾಂಕ", "ದಿನಾಂಕ"],
        "mr": ["नोंदणी दिनांक", "दिनांक"],
        "hi": ["पंजीकरण दिनांक", "पंजीयन तिथि", "दिनांक"],
        "ta": ["பதிவு தேதி", "தேதி"],
        "te": ["రిజిస్ట్రేషన్ తేదీ", "తేదీ"],
        "en": ["registration date", "presented for registration", "registered on", "dated", "date"],
    },
    "issued": {
        "bn": ["অবিকল নকল", "নকল প্রদানের তারিখ", "সহি মোহরকৃত", "ইস্যু তারিখ"],
        "kn": ["ಪ್ರಮಾಣೀಕೃತ ಪ್ರತಿ ದಿನಾಂಕ", "ವಿತರಣೆ ದಿನಾಂಕ"],
        "mr": ["नक्कल प्रत दिनांक"],
        "hi": ["प्रमाणित प्रतिलिपि दिनांक", "जारी दिनांक"],
        "ta": ["சான்றளிக்கப்பட்ட நகல் தேதி"],
        "te": ["ధృవీకరించబడిన కాపీ తేదీ"],
        "en": ["issue date", "certified copy date", "certified true copy", "issued on"],
    },
}

#: Month names in the order in which they are tried; twelve of each but the short English ones, which have no may.
MONTHS = {
    "bn": ["জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর"],
    "hi": ["जनवरी", "फरवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "short": ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"],
}

#: Words of each area unit, in the order in which units and words are tried.
UNIT_WORDS = {
    "acre": ["acre", "acres", "একর", "ಎಕರೆ", "एकर", "ஏக்கர்"],
    "hectare": ["hectare", "hectares", "হেক্টর", "ಹೆಕ್ಟೇರ್", "हेक्टर", "हे."],
    "bigha": ["bigha", "বিঘা", "बीघा"],
    "katha": ["katha", "কাঠা", "कट्ठा"],
    "gunta": ["gunta", "guntas", "guntha", "గుంట", "ಗುಂಟೆ", "गुंठा", "गुंटे"],
    "cent": ["cent", "cents", "சென்ட்", "సెంట్"],
    "decimal": ["decimal", "শতক", "ডেসিমাল", "ডেসি."],
    "are": ["are", "आर", "आ."],
}

#: Square metres of the units that can be read, by state; a unit that a state lacks counts as one.
UNIT_SQUARE_METRES = {
    "west bengal": {"acre": 4046.86, "hectare": 10000.0, "bigha": 1333.33, "katha": 66.67, "decimal": 40.47},
    "karnataka": {"acre": 4046.86, "hectare": 10000.0, "gunta": 101.17, "cent": 40.47},
    "maharashtra": {"acre": 4046.86, "hectare": 10000.0, "gunta": 101.17, "are": 100.0},
    "default": {"acre": 4046.86, "hectare": 10000.0, "bigha": 2500.0, "cent": 40.47, "decimal": 40.47},
}

#: Words that let a line without an anchor be read as an area.
AREA_HINTS = ["একর", "acre", "বিঘা", "bigha", "শতক", "guntha", "gunta", "cent"]
#: Words that a survey or khata number can't hold, and those between an owner and the guardian, in the order tried.
NOT_NUMBERS = ["তথ্য", "দাগের"]
GUARDIANS = ["s/o", "w/o", "d/o", "পিতা", "पिता"]
DAY_SUFFIXES = ["শে", "ই", "তম", "th", "st", "nd", "rd"]

#: Scripts in the order that breaks ties: first and last code point, default language, its name.
SCRIPTS = {
    "Devanagari": (0x0900, 0x097F, "hi", "Hindi / Marathi"),
    "Bengali": (0x0980, 0x09FF, "bn", "Bengali"),
    "Gurmukhi": (0x0A00, 0x0A7F, "pa", "Punjabi"),
    "Gujarati": (0x0A80, 0x0AFF, "gu", "Gujarati"),
    "Odia": (0x0B00, 0x0B7F, "or", "Odia"),
    "Tamil": (0x0B80, 0x0BFF, "ta", "Tamil"),
    "Telugu": (0x0C00, 0x0C7F, "te", "Telugu"),
    "Kannada": (0x0C80, 0x0CFF, "kn", "Kannada"),
    "Malayalam": (0x0D00, 0x0D7F, "ml", "Malayalam"),
    "Urdu_Arabic": (0x0600, 0x06FF, "ur", "Urdu"),
    "Latin": (0x0041, 0x007A, "en", "English"),
}

#: States in the order in which they are tried: language, its name, script, OCR pack.
STATES = {
    "karnataka": ("kn", "Kannada", "Kannada", "kan"),
    "maharashtra": ("mr", "Marathi", "Devanagari", "mar"),
    "tamil nadu": ("ta", "Tamil", "Tamil", "tam"),
    "andhra pradesh": ("te", "Telugu", "Telugu", "tel"),
    "telangana": ("te", "Telugu", "Telugu", "tel"),
    "west bengal": ("bn", "Bengali", "Bengali", "ben"),
    "bengal": ("bn", "Bengali", "Bengali", "ben"),
    "gujarat": ("gu", "Gujarati", "Gujarati", "guj"),
    "punjab": ("pa", "Punjabi", "Gurmukhi", "pan"),
    "kerala": ("ml", "Malayalam", "Malayalam", "mal"),
    "odisha": ("or", "Odia", "Odia", "ori"),
    "uttar pradesh": ("hi", "Hindi", "Devanagari", "hin"),
    "madhya pradesh": ("hi", "Hindi", "Devanagari", "hin"),
    "rajasthan": ("hi", "Hindi", "Devanagari", "hin"),
    "bihar": ("hi", "Hindi", "Devanagari", "hin"),
    "haryana": ("hi", "Hindi", "Devanagari", "hin"),
    "delhi": ("hi", "Hindi", "Devanagari", "hin"),
    "himachal pradesh": ("hi", "Hindi", "Devanagari", "hin"),
    "jharkhand": ("hi", "Hindi", "Devanagari", "hin"),
    "chhattisgarh": ("hi", "Hindi", "Devanagari", "hin"),
    "uttarakhand": ("hi", "Hindi", "Devanagari", "hin"),
    "assam": ("as", "Assamese", "Bengali", "asm"),
    "jammu and kashmir": ("ur", "Urdu", "Urdu_Arabic", "urd"),
    "goa": ("kok", "Konkani", "Devanagari", "kok"),
}

#: Zero digits of the nine scripts whose digits are folded, and the digits that are left as they are.
ZEROS = {"Bengali": 0x09E6, "Devanagari": 0x0966, "Kannada": 0x0CE6, "Tamil": 0x0BE6, "Telugu": 0x0C66, "Gujarati": 0x0AE6, "Gurmukhi": 0x0A66, "Odia": 0x0B66, "Malayalam": 0x0D66}
NOT_FOLDED = [0x0A6C, 0x0A6E, 0x0B6A]

#: File types that are taken, with their extension; other spellings of an extension.
FILE_TYPES = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/tiff": ".tiff", "image/webp": ".webp"}
OTHER_EXTENSIONS = {".jpeg": "image/jpeg", ".tif": "image/tiff"}
MOST_FILE_BYTES = 50 * 1024 * 1024
