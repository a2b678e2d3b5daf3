"""Dictionary entries: compact grammar notes, transliteration, word and domain tests."""

from __future__ import annotations

import re

# The order in which other parts of speech are tried.
POS_FALLBACKS = {
    "VERB": ["VERB", "AUX", "ADJ", ""],
    "AUX": ["AUX", "VERB", ""],
    "NOUN": ["NOUN", "PROPN", "ADJ", "NUM", ""],
    "PROPN": ["PROPN", "NOUN", "ADJ", ""],
    "NUM": ["NUM", "NOUN", ""],
    "PRON": ["PRON", "DET", ""],
    "ADJ": ["ADJ", ""],
    "ADV": ["ADV", ""],
}
PHRASE_POS = ["PHRASE", "VERB", "NOUN", "ADJ", "ADV", ""]
DOMAINS = ["general", "med", "art"]
ARTICLES = ["a", "an", "the"]

# Words that name a domain.
DOMAIN_WORDS = {
    "med": """patient patients disease diseases disorder diagnosis treatment therapy drug drugs medicine medical clinical
symptom symptoms hospital surgery infection inflammatory inflammation immune blood cell cells tissue organ physician
doctor nurse cancer tumor chronic acute mortality morbidity health healthcare vaccine antibody gene genetic protein
dose prescription trial cohort placebo medication screening biopsy cardiovascular respiratory neural muscle bone
kidney liver lung lungs""".split(),
    "art": """art artist artists painting paintings painter canvas brushstroke color palette composition sculpture statue
exhibition museum gallery critic criticism aesthetic masterpiece portrait landscape genre visual style technique
texture hue tone shade impressionism expressionism cubism surrealism baroque renaissance decorative ornament artwork
viewer sketch watercolor fresco acrylic perspective harmony""".split(),
}

# Letter groups and letters in Cyrillic.
GROUPS = {
    "tion": "ция", "sion": "зия", "tial": "циаль", "cial": "циаль", "ough": "о", "ight": "айт", "ch": "ч", "sh": "ш",
    "th": "т", "ph": "ф", "ck": "к", "qu": "кв", "wh": "в", "ee": "и", "ea": "и", "oo": "у", "ou": "у", "oi": "ой",
    "ay": "ей", "ey": "и", "au": "о", "ai": "ей", "ei": "ей", "ia": "ия", "ct": "кт", "ll": "лл", "mm": "мм",
    "ss": "сс", "rr": "рр",
}
LETTERS = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к",
    "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в",
    "x": "кс", "y": "и", "z": "з",
}

_PIECE = re.compile("|".join(sorted(GROUPS, key=len, reverse=True)) + "|c(?=[eiy])|.", re.DOTALL)
_FLAGS = {"m": ("gender", "m"), "f": ("gender", "f"), "n": ("gender", "n"), "anim": ("anim", True), "inv": ("inv", True), "adjdecl": ("adjdecl", True), "impf": ("aspect", "impf"), "pf": ("aspect", "pf")}


def parse_gram(text: str | None) -> dict:
    """`m,anim,gpl:врачей,forms:pastm=шёл;pastf=шла` as a dictionary."""
    out: dict = {}
    for part in map(str.strip, (text or "").split(",")):
        if part in _FLAGS:
            name, value = _FLAGS[part]
            out[name] = value
        elif ":" in part:
            name, value = (x.strip() for x in part.split(":", 1))
            if name == "forms":
                pairs = (x.split("=", 1) for x in value.split(";") if "=" in x)
                out.setdefault("forms", {}).update({k.strip(): v.strip() for k, v in pairs if k.strip() and v.strip()})
            elif name and value:
                out[name] = value
    if not out.get("forms", True):
        del out["forms"]
    return out


def serialize_gram(gram: dict) -> str:
    """F24, back again."""
    out = [gram["gender"]] if gram.get("gender") else []
    out += [k for k in ("anim", "inv") if gram.get(k)]
    out += [gram["aspect"]] if gram.get("aspect") else []
    out += ["adjdecl"] if gram.get("adjdecl") else []
    out += [f"{k}:{gram[k]}" for k in ("pair", "pp", "pl", "gpl", "gov", "comp", "sup", "compattr") if gram.get(k)]
    if gram.get("forms"):
        out.append("forms:" + ";".join(f"{k}={v}" for k, v in gram["forms"].items()))
    return ",".join(out)


def transliterate(word: str) -> str:
    """an English word in Cyrillic, longest groups first; -y after vowel and consonant gets я."""

    def one(piece: str) -> str:
        if piece in GROUPS:
            return GROUPS[piece]
        if piece == "c":  # the lone c that the pattern found before e, i or y, or any other
            return "к"
        return LETTERS.get(piece, piece) if piece.isalpha() else piece if piece == "-" else ""

    low, out = word.lower(), ""
    for m in _PIECE.finditer(low):
        soft = m[0] == "c" and low[m.end() : m.end() + 1] in ("e", "i", "y")
        out += "ц" if soft else one(m[0])
    if re.search(r"[aeiouy][^aeiouy]y$", low) and len(low) > 3:
        out += "я"
    return out.capitalize() if word[:1].isupper() else out


def suggest(word: str, pos: str | None) -> str:
    """a translation to propose, for names, nouns and capitalised words only."""
    return transliterate(word) if (pos or "").upper() in ("PROPN", "NOUN", "X") or word[:1].isupper() else ""
