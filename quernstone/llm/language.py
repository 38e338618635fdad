"""Language of prose by script and function words; code, code comments, markup and addresses are left out."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

from quernstone.llm.markup import code_regions

#: Function words of languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "a the of and to in is was are were be been for with that this it its on as by from at an or not has have had which when if then than but will can may must should would no into every each does what why how he she they we you your our their one only some all other more after before since about between because so there here these those being do did me now both still never could might while where who whose them us my his her any such very just also too until within without through during against under over again once",
    "de": "der die das und ist nicht ein eine einen einem einer eines mit von zu den dem des im für auf als auch wird werden wurde sind war bei nach aus über nur noch wenn wie oder aber vor durch sich es er sie ich wir ihr man kann bitte seit warum jetzt am zum zur dass weil hat haben gilt während vom ca mir mich dir dich uns euch weniger ohne dabei diese dieser dieses jede jeder jedes kein keine keinen mein dein sein ihre unser bis unter zwischen gegen schon sehr mehr immer wieder dann denn doch hier dort wo was wer muss soll darf könnte würde waren bin bist",
    "fr": "le la les des du de un une et est dans pour que qui ne pas avec sur par au aux ce cette ces se sa son ses il elle on nous vous ils elles plus mais ou où si lorsque quand depuis pourquoi jamais pendant maintenant sans tout très comment peux tu me être été avoir fait en leur comme cela chaque je mon ma mes ton ta tes notre votre sont était sera peut doit y dont donc puis aussi encore toujours sous entre vers chez avant après même autre toute tous",
    "es": "el la los las de del un una unos unas es en para que no con por se su sus lo al como más pero o si cuando desde porque qué durante ahora sin todo muy ser ha han fue está esto cada según cómo puedes me ya yo tú él ella nosotros mi mis tu tus este esta estos estas ese esa son era será puede debe hay entre hasta sobre también siempre nunca donde quien cual otro otra antes después mismo así y",
}
#: Plain text of each language, from which its letter sequences are learned.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They should act towards one another in a spirit of friendship. The small library near the station opens early in the morning and closes late at night. Children read picture books while their parents drink coffee and talk about the weather. Whoever writes software spends much of the day reading what other people wrote before. Open files should be closed properly, and broken links deserve quick repairs. Good tests catch mistakes early and make later changes cheaper. Object oriented programming simplifies maintenance when classes remain small. The network connection failed twice, although the server answered every request. Yesterday the weather changed suddenly; strong winds brought heavy rain from the north. Farmers grow wheat, barley and potatoes on the wide fields behind the village. Learning languages requires patience, practice and curiosity. Some students prefer mathematics, others choose history or chemistry. Memory usage increased slowly until the process stopped. Choose short names, avoid global variables, handle errors close to their source. Our neighbours bought an old house with a beautiful garden and seven apple trees. Database queries return results faster with a suitable index. Nothing works without electricity, water and friendly people.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sollen einander im Geist der Freundschaft begegnen. Die kleine Bücherei am Bahnhof öffnet früh am Morgen und schließt spät in der Nacht. Kinder lesen Bilderbücher, während ihre Eltern Kaffee trinken und sich über das Wetter unterhalten. Wer Software schreibt, verbringt viel Zeit mit dem Lesen fremder Zeilen. Geöffnete Dateien sollten ordentlich geschlossen werden, und fehlerhafte Verweise verdienen schnelle Reparaturen. Gute Prüfungen finden Fehler frühzeitig und machen spätere Änderungen günstiger. Objektorientierte Entwicklung erleichtert die Pflege, solange Klassen überschaubar bleiben. Die Netzwerkverbindung brach zweimal ab, obwohl der Rechner jede Anfrage beantwortete. Gestern änderte sich das Wetter plötzlich; starker Wind brachte heftigen Regen aus dem Norden. Bauern pflanzen Weizen, Gerste und Kartoffeln auf den weiten Feldern hinter dem Dorf. Sprachen lernen verlangt Geduld, Übung und Neugier. Manche Schüler mögen Mathematik, andere wählen Geschichte oder Chemie. Der Speicherverbrauch stieg langsam, bis das Programm abbrach. Wähle kurze Namen, vermeide globale Veränderliche, behandle Ausnahmen nahe an ihrer Quelle. Unsere Nachbarn kauften ein altes Haus mit einem schönen Garten und sieben Apfelbäumen. Abfragen der Datenbank liefern Ergebnisse schneller mit passendem Verzeichnis. Nichts funktioniert ohne Strom, Wasser und freundliche Leute.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils doivent agir les uns envers les autres dans un esprit d'amitié. La petite bibliothèque près de la gare ouvre tôt le matin et ferme tard dans la nuit. Les enfants lisent des livres d'images pendant que leurs parents boivent du café et parlent du temps. Celui qui écrit des logiciels passe beaucoup de temps à lire ce que d'autres ont écrit auparavant. Les fichiers ouverts devraient être fermés correctement, et les liens cassés méritent des réparations rapides. De bons essais découvrent les erreurs rapidement et rendent les changements ultérieurs moins coûteux. La programmation orientée objet simplifie l'entretien quand les classes restent petites. La connexion au réseau a échoué deux fois, bien que le serveur ait répondu à chaque requête. Hier le temps a changé soudainement ; des vents forts ont apporté une pluie violente du nord. Les paysans cultivent du blé, de l'orge et des pommes de terre dans les champs derrière le village. Apprendre des langues demande de la patience, de l'exercice et de la curiosité. Certains élèves préfèrent les mathématiques, d'autres choisissent l'histoire ou la chimie. L'utilisation de la mémoire augmentait lentement jusqu'à l'arrêt du processus. Choisissez des noms courts, évitez les variables globales, traitez les erreurs près de leur source. Nos voisins ont acheté une vieille maison avec un beau jardin et sept pommiers. Les requêtes renvoient des résultats plus vite avec un index adapté. Rien ne marche sans électricité, sans eau et sans gens aimables.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos. Deben comportarse los unos con los otros con espíritu de amistad. La pequeña biblioteca cerca de la estación abre temprano por la mañana y cierra tarde por la noche. Los niños leen libros ilustrados mientras sus padres beben café y hablan del tiempo. Quien escribe programas pasa mucho tiempo leyendo lo que otras personas escribieron antes. Los archivos abiertos deberían cerrarse correctamente, y los enlaces rotos merecen reparaciones rápidas. Las buenas pruebas descubren errores pronto y abaratan los cambios posteriores. La programación orientada a objetos simplifica el mantenimiento cuando las clases permanecen pequeñas. La conexión de red falló dos veces, aunque el servidor respondió a cada petición. Ayer el tiempo cambió de repente; vientos fuertes trajeron lluvia intensa desde el norte. Los campesinos cultivan trigo, cebada y patatas en los anchos campos detrás del pueblo. Aprender idiomas requiere paciencia, práctica y curiosidad. Algunos alumnos prefieren matemáticas, otros eligen historia o química. El uso de memoria aumentó lentamente hasta que el proceso se detuvo. Elige nombres cortos, evita variables globales, trata los errores cerca de su origen. Nuestros vecinos compraron una casa vieja con un jardín hermoso y siete manzanos. Las consultas devuelven resultados más rápido con un índice adecuado. Nada funciona sin electricidad, agua y gente amable.",
}
_WORDS: dict[str, dict[str, float]] = {}
for _lang, _text in FUNCTION_WORDS.items():
    for _w in set(_text.split()):
        _WORDS.setdefault(_w, {})[_lang] = 1.0
for _share in _WORDS.values():
    for _lang in _share:
        _share[_lang] = 1.0 / len(_share) ** 2
# Letters and marks that point to one of these languages.
MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "„": "de", "ñ": "es", "¿": "es", "¡": "es", "í": "es", "ó": "es", "á": "es", "ú": "es", "è": "fr", "ê": "fr", "ç": "fr", "à": "fr", "û": "fr", "î": "fr", "ô": "fr", "œ": "fr", "ù": "fr"}

_URL = re.compile(r"\b(?:https?|ftp)://\S+|</?[A-Za-z][^<>]*>|&#?\w+;|\\[A-Za-z]+")
_PLAIN = re.compile(r"(?<![\w.])[^\W\d_][^\W\d_A-Z]*(?![\w(])")
_LATIN = re.compile(r"[^\W\d_]+")
_MARK = re.compile(f"[{''.join(MARKS)}]")
_KANA = re.compile("[ぁ-ゖァ-ヺーｦ-ﾟ]")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_CYRILLIC = re.compile("[Ѐ-ӿ]+")
_HANGUL = re.compile("[가-힣]")
_ARABIC = re.compile("[؀-ۿݐ-ݿ]+")
_NAGARI = re.compile("[ऀ-ॿ]+")
_THAI = re.compile("[฀-๿]")
_CODE_LINE = re.compile(
    r"^[ \t]*(?:#(?!#*[ \t]*\S+[ \t]*$).*|//.*|(?:def|class|import|from|return|assert|raise|try|except|finally|with|for|while|if|elif|else|match|case|print|async|await|pass|yield|del|global|nonlocal|lambda)\b.*[:()=\]'\"\w]|@\w.*|>>>.*|\.\.\.(?:[ \t].*|$)|[\w.\[\]'\", ]+[ \t]*(?:=|\+=|-=)[ \t]*[^=\s].*|[\w.]+\([^\s.]*\)?[ \t]*)$"
)


def prose(text: str) -> str:
    """The text without code: marked code, and runs of two or more lines that read as code or are indented under them."""
    out, at = [], 0
    if "`" in text or "~~~" in text or "<" in text or "\\" in text:
        for a, b, c, d, kind in code_regions(text):
            if kind in ("span", "code", "tt", "kbd", "samp", "verb"):
                continue
            out.append(text[at:a])
            at = d
        text = "".join((*out, text[at:]))
    if "\n" in text and ("(" in text or "=" in text or "#" in text):
        lines, keep, run = text.split("\n"), [], []
        for line in [*lines, None]:
            if line is not None and (_CODE_LINE.match(line) or run and line.startswith(("    ", "\t")) and line.strip()):
                run.append(line)
                continue
            if len(run) == 1 and not run[0].startswith(("    ", "\t")):
                keep += run
            run = []
            if line is not None:
                keep.append(line)
        text = "\n".join(keep)
    return _URL.sub(" ", text)


def scores(text: str) -> Counter:
    """Evidence per language, in about one unit per word."""
    found: Counter = Counter()
    if not text.isascii():
        if not text.isprintable():
            text = unicodedata.normalize("NFC", text)
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        if kana + han:
            found["ja" if kana * 10 > han else "zh"] = (kana + han) / 2
        for lang, pattern in (("ru", _CYRILLIC), ("ar", _ARABIC), ("hi", _NAGARI)):
            if n := len(pattern.findall(text)):
                found[lang] = n
        for lang, pattern in (("ko", _HANGUL), ("th", _THAI)):
            if n := len(pattern.findall(text)):
                found[lang] = n / 3
        for c, n in Counter(_MARK.findall(text)).items():
            found[MARKS[c]] += n / 2
        if n := text.count("é"):
            found["fr"] += n / 4
            found["es"] += n / 8
    known = _WORDS.get
    for w in _LATIN.findall(text):
        if (share := known(w)) or (share := known(w.lower())):
            for lang, x in share.items():
                found[lang] += x
    return found


@lru_cache(1)
def _letters() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Log-likelihoods of letter sequences of two to four letters per language of :data:`SAMPLES`, and those of unseen ones."""
    counts = [Counter(g for w in _LATIN.findall(text.lower()) for g in _sequences(w)) for text in SAMPLES.values()]
    every = set().union(*counts)
    total = np.array([sum(c.values()) + 0.3 * len(every) for c in counts])
    return {g: np.log((np.array([c[g] for c in counts]) + 0.3) / total) for g in every}, np.log(0.3 / total)


def _sequences(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for n in (2, 3, 4) for k in range(len(padded) - n + 1)]


def by_letters(text: str, least: float = 1.5) -> Counter:
    """Evidence per language of :data:`SAMPLES` from the letter sequences of the words, at most one unit per word; names
    with capitals, digits or underscores inside count for nothing, nor do all if the two likeliest languages differ by less
    than ``least`` in log-likelihood."""
    known, unseen = _letters()
    sums, words = np.zeros(len(SAMPLES)), 0
    for w in _PLAIN.findall(text):
        sums += sum((known.get(g, unseen) for g in _sequences(w.lower())), np.zeros(len(SAMPLES)))
        words += 1
    if not words or np.diff(np.sort(sums)[-2:])[0] < least:
        return Counter()
    share = np.exp((sums - sums.max()) / 3)
    return Counter({lang: words * float(p) for lang, p in zip(SAMPLES, share / share.sum())})


def language(text: str | None, among: tuple[str, ...] | None = None, default: str = "en") -> str | None:
    """The language of a text's prose, None for null or blank texts. Where function words and marks leave it open between
    languages of Latin letters, letter sequences decide. With no evidence in the prose the whole text counts, and without
    any the default."""
    if text is None or not text.strip():
        return None
    for part in (prose, lambda t: t):
        plain = part(text)
        found = scores(plain)
        first, second = ([n for _, n in found.most_common(2)] + [0, 0])[:2]
        if first - second <= 1 and not any(k not in SAMPLES for k in found):
            found.update(by_letters(plain))
        if among:
            found = Counter({k: v for k, v in found.items() if k in among})
        if found:
            return max(found, key=lambda k: (found[k], k))
    return default
