"""Language of a text by script and function words."""

from __future__ import annotations

import re

# Function words that are frequent in one of the languages and rare in the others.
_WORDS = {
    "en": "the of and to is are be shall by for that with not which this have has was were an it you your if or any may must when where who what does under on from at as no he she they we can will do did how his her their there then said but so out up into about than would been such",
    "fr": "le la les des du est et une dans pour par que qui sur au aux ne pas avec sont ce cette il elle sans leur ses sera peut être avant après lorsque selon nul ou en vous nous son sa dont quel quelle ont été fait était c'est qu'il n'est l'article d'un d'une si doit",
    "de": "der die das und ist nicht den dem ein eine einer eines zu mit von auf für im des sich wird werden kann wenn oder bei nach aus auch sind hat durch vor wer welche soll muss darf es sie er ohne einen einem zur zum über wurde nur noch sofern soweit als wie",
    "es": "el los las del una que por para con es se su al lo como más pero sus le ya este cuando qué quién según podrá será puede antes después sin nadie y en la un esta son ha sido no hay si entre sobre desde hasta fue",
    "it": "il gli della delle dei degli che è per con non una sono del nel nella alla al dal questo questa anche più come essere può",
    "pt": "os das dos que não uma com para é em são pelo pela ao mais como mas foi ser pode quando muito já também seu sua",
    "nl": "het een van en niet dat zijn voor met op aan door wordt worden ook bij naar uit maar deze dit kan moet als",
}
_OF_WORD: dict[str, list[str]] = {}
for _language, _list in _WORDS.items():
    for _w in _list.split():
        _OF_WORD.setdefault(_w, []).append(_language)

_SCRIPTS = (
    ("si", re.compile("[඀-෿]")),
    ("ta", re.compile("[஀-௿]")),
    ("other", re.compile("[Ͱ-ϿЀ-ԯ԰-׿؀-ۿऀ-୿ఀ-ൿ฀-࿿ᄀ-ᇿ぀-ヿ㐀-鿿가-힯]")),
)
_LATIN = re.compile("[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)?")


def language_scores(text: str) -> dict[str, float]:
    """Evidence per language: letters by script count a third of a word, function words one, shared ones a part."""
    out: dict[str, float] = {}
    for name, script in () if text.isascii() else _SCRIPTS:
        if n := len(script.findall(text)):
            out[name] = n / 3
    for w in _LATIN.findall(text.lower().replace("’", "'")):
        if owners := _OF_WORD.get(w):
            for o in owners:
                out[o] = out.get(o, 0) + 1 / len(owners)
    return out


def language_of(text: str | None, least: float = 1.5, lead: float = 1.4) -> str | None:
    """The language with most evidence if there is enough of it and it leads clearly, else None."""
    s = sorted(language_scores(text or "").items(), key=lambda x: -x[1])
    if not s or s[0][1] < least or len(s) > 1 and s[0][1] < lead * s[1][1]:
        return None
    return s[0][0]


# The letters besides a to z with which words of a language are written.
_LETTERS = {"en": "éèêëïôöçñæœ", "fr": "àâæçéèêëîïôœùûüÿ", "de": "äöüßé", "es": "áéíñóúü", "it": "àèéìíîòóùú", "pt": "áâãàçéêíóôõúü", "nl": "áéëïíóöúüè"}


def is_foreign(text: str, language: str, least: int = 5) -> bool:
    """Words of Latin letters, ``least`` or more, none of them a function word of the language, and a tenth of them with letters that it does not use."""
    words = _LATIN.findall(text.lower())
    if language not in _LETTERS or len(words) < least or language_scores(text).get(language):
        return False
    own = set("abcdefghijklmnopqrstuvwxyz'’" + _LETTERS[language]) - (set("öäëïôêèçæœñ") if language == "en" else set())
    return sum(not set(w) <= own for w in words) * 10 >= len(words)
