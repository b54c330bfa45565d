"""Codes, word lists and character lists that results depend on."""

import unicodedata

# Severity codes, five classes and two classes.
SEVERITY_CODES = {"NULLE": 0, "MINEU": 1, "MOYEN": 2, "SEVER": 3, "CRITI": 4}
SEVERITY_BINARY_CODES = {"NULLE": 1, "MINEU": 1, "MOYEN": 1, "SEVER": 1, "CRITI": 0}
SEVERITY_BINARY_NAMES = {0: "CRITI", 1: "NON CRITIQUE"}

# Codes given to declarations without a label.
DEFAULT_EFFECT = "E1213"
DEFAULT_DYSFUNCTION = "D0"
DEFAULT_CONSEQUENCE = "C0"
NOT_FILLED = "NON RENSEIGNE"
NOT_LISTED = "NON_LISTE"

# Device-family labels that carry no information.
UNINFORMATIVE_FAMILIES = [
    "TOUTES LES DCO", "AUTRE DIV", "INCONNU - REACTO", "NON DIV", "NRV", "INCONNU",
    "NDM", "NMV", "PSIG", "PSIG2", "Tous", "TOUS LES DIV",
]

# Effect codes too general to learn from.
GENERIC_EFFECTS = ["E1213", "E1454", "E1210", "E2280"]

# Dysfunctions never chosen by the reference-list rule.
EXCLUDED_DYSFUNCTIONS = [2338, 1859]

# Declarant groups.
CITIZEN = "Citoyen"
PROFESSIONAL = "Etablissements et professionnels de santé"

# Form questions removed when a form is anonymised.
PERSONAL_QUESTIONS = [
    "Nom", "Prénom", "Téléphone", "Adresse électronique", "Adresse postale", "Code postal / Commune",
    "Nom (3 premières lettres)", "Sexe", "Date de naissance", "ou âge (réel ou estimé)", "Poids",
    "Date de survenue", "Période de survenue", "Type de lieu de survenue", "Date de survenue de l'incident",
    "Date de détection de l'incident", "Profession", "Complément profession",
    "Téléphone ou pour les correspondants locaux : Télécopie", "Nom de l'établissement ou de l'organisme",
    "Age (réel ou estimé)", "Nom de l'etablissement", "Adresse", "Service",
    "Personne à contacter dans l'établissement", "Téléphone du contact",
    "Êtes vous la personne ayant présenté les symptômes  ?", "Veuillez préciser votre lien avec la personne",
    "Êtes-vous le correspondant de matériovigilance ou son suppléant ?",
    "Êtes-vous le correspondant de réactovigilance ou son suppléant ?",
    "Si vous êtes dans un établissement de santé, il est préférable de prendre contact avec votre correspondant "
    "local de matériovigilance qui a pour rôle de recevoir et transmettre ensuite les déclarations à l'ansm. "
    "Sinon, vous pouvez les transmettre à l'ansm vous-même via ce portail.",
]

# Frequent misspellings and their corrections.
MISSPELLINGS = {
    "cest": "c'est",
    "controlaterale": "controlatérale",
    "\x9cdème": "oedème",
    "\x9cdèmes": "oedèmes",
    "léchographie": "échographie",
    "desaturation": "désaturation",
    "\x9cil": "oeil",
    "limplant": "implant",
    "hemorragiques": "hémorragiques",
    "hypoglycemie": "hypoglycémie",
    "lautomate": "automate",
    "l\x9cil": "oeil",
    "adenopathie": "adénopathie",
    "prothetique": "prothétique",
    "inapproprie": "inapproprié",
    "lartère": "artère",
    "asthenie": "asthénie",
    "man\x9cuvre": "manoeuvre",
    "lexplantation": "explantation",
    "lymphoree": "lymphorée",
    "salpyngectomie": "salpingectomie",
    "burnaout": "burnout",
    "lnterventlon": "intervention",
    "pericardique": "péricardique",
    "lendométriose": "endométriose",
    "daudition": "audition",
    "désaltére": "désaltéré",
    "cephalee": "céphalée",
    "salpaginctomie": "salpingectomie",
    "menauposée": "ménopausée",
    "deczéma": "eczéma",
    "peritonite": "péritonite",
    "lablation": "ablation",
    "microjyste": "microkyste",
    "généralié": "généralité",
    "débriété": "ébriété",
    "acidocetose": "acidocétose",
    "dhéparine": "héparine",
    "dincident": "incident",
    "daiguille": "aiguille",
    "materiovigilance": "matériovigilance",
    "adenomyose": "adénomyose",
}

# Characters that cleaning pads with spaces, beside the ASCII punctuation.
PADDED_CHARACTERS = (
    "•£·©®→°€™›♥←×§″′Â█½…“★”–●â►−¢²¬░¶↑±¿▾═¦║―¥▓—‹─▒：¼⊕▼▪†■’▀¨▄♫☆¯♦¤▲¸¾Ã⋅‘∞∙）↓、│（»，♪╩╚³・╦╣╔╗▬❤ïØ¹≤‡√"
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Elided articles that cleaning drops, wherever they stand.
ELIDED_ARTICLES = ["d'", "l'", "t'", "s'"]

# Stems that speak of a death, as substrings and as whole words.
DEATH_STEMS = [
    "mort", "morts", "meurt", "mourir", "mortel", "deces", "deceder", "decede", "decedee", "decedes",
    "decedait", "decedais", "dcd",
]
DEATH_WORDS = DEATH_STEMS[:11]

# Company-form words dropped from a manufacturer's name.
COMPANY_WORDS = ["france", "sarl", "sas", "ltd", "inc", "sro", "sa", "ab"]

# Default stop words: common French function words. Every text operator takes its
# own list instead; a full list is a reference table of the user.
STOP_WORDS = [
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "des", "du", "elle", "elles", "en", "est", "et",
    "il", "ils", "je", "la", "le", "les", "leur", "lui", "mais", "me", "mes", "mon", "ne", "nos", "notre",
    "nous", "on", "ou", "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sur", "ta", "te",
    "tes", "ton", "tu", "un", "une", "vos", "votre", "vous",
]
MEASURE_WORDS = ["min", "minute", "minutes", "heure", "heures", "jour", "jours", "mois", "annee", "annees"]

# Accented letters and their plain forms, one to one.
# Built from Unicode: every Latin letter that decomposes into an ASCII letter and marks; loose marks
# are at the end, where translate deletes them.
_FOLDED = {
    chr(c): base
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if (base := unicodedata.normalize("NFD", chr(c))[0]).isascii() and base.isalpha()
} | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}
ACCENTED = "".join(_FOLDED) + "".join(map(chr, range(0x300, 0x370)))
UNACCENTED = "".join(_FOLDED.values())
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss"}

# Decision thresholds of the multi-label models.
LABEL_THRESHOLDS = {"TEF": 0.12, "CDY": 0.2, "TDY": 0.12}

# Weights of the macro score.
MACRO_WEIGHTS = {"dco": 0.5, "typology": 0.3, "manufacturer": 0.2}
