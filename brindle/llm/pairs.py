"""Problem 3: defective pairs of a prompt and its answer.

Ordered rules give every defect that applies (``defects``), and the first one is the defect of the pair:

1. refusal: a refusal reason is set, or every sentence of the text declines or accompanies a refusal (four languages);
2. empty: nothing is left without markup, invisible characters and stand-ins such as "N/A" or "[]";
3. copy: the text is the prompt, once or several times, with or without a label before it;
4. language: the text's language is not the requested one or, if none is requested, that of the prompt;
5. truncated: an open code block, bracket or quotation mark, or a last sentence or list item that stops before its end.

Languages are told by their script, their function words and letters. A fetch error decides nothing: errors stand beside
complete answers, and what an error cut off shows in the text. Answers of a few bare items have neither; they are decided by
a lexicon of list items that is counted over all answers whose language is certain: the language an item is used in,
and whether the last item of a list is a known item or only the beginning of one. Only such pairs are joined with it.

Defined cases: a pair without a known prompt has no copy or language defect; null and blank refusal reasons are none;
ties between languages decide nothing; several rows of one key with different content each count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks
from brindle.session import cut

ORDER = ("refusal", "empty", "copy", "language", "truncated")
#: Uses from which an item of the lexicon counts as known.
KNOWN = 2
#: Words of a list item that the lexicon holds; a longer one is a clause, which its own end and its neighbours judge.
WORDS = 6
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")

#: Function words by language.
FUNCTION_WORDS = {
    "en": "a an the of and to in is are was were that than for with on at by from it its as be been but not no or if so than this these those which who whom whose what when where why how do does did has have had can could will would should may might must they them their there here you your we our us he she his her i my me all any some each other more most over under between before after during without within near about into out up down off only also very well such because since while although unless until even though through against both either neither nor one two three too".split(),
    "pl": "i w we z ze na do od po za o u przy przez dla bez nad pod przed między nie że się jest są był była było były to ten ta te tego tej tym tych oraz lub albo ale lecz a jak jako co czy czym czemu dlaczego kto który która które którzy których gdy gdzie kiedy jeśli ponieważ bo więc choć gdyż mimo niż już jeszcze tylko także też bardzo może można ma mają mój moje twój jego jej ich nas was nam sobie mnie ja on ona oni one my wy nikt nic żeby aby dopóki zanim oto tak inaczej więcej mniej".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde hat haben hatte mit von vom zu zum zur im in ins am an auf aus bei beim für über unter vor nach zwischen ohne durch gegen um bis seit als wie wenn weil da dass obwohl sodass sofern solange auch noch nur sehr mehr weniger sich es er sie wir ihr ihre ihren ihrem ich mich mir du sein seine was wer welche welcher welches warum wo wann alle aller so doch hier dort man kann muss soll darf niemand etwas andere anderen".split(),
    "es": "el la los las un una unos unas de del al a en y e o u que no se es son era fue con por para sin sobre entre hasta desde como cómo qué quién quiénes cuál cuáles cuándo dónde porque aunque si sino pero más menos muy también ya lo le les su sus mi mis tu tus nuestro nuestra nuestros nuestras este esta estos estas ese esa eso esto aquel donde cuando mientras salvo según tras antes después nadie algo otra otro otros otras todo toda todos hay ha han ser está están puede debe".split(),
}
#: Other languages, told only where they clearly outnumber the above.
MORE_WORDS = {
    "fr": "le la les un une des du de et est sont dans pour par sur avec qui que ne pas plus ce cette ces il elle nous vous ils au aux en se sa son ses leur mais ou où été être ont très comme".split(),
    "it": "il lo la gli le un una dei delle della del di e è sono nel nella per con che non più questo questa questi si su da dal alla ai come anche ma o stato essere hanno molto perché quando".split(),
    "pt": "o a os as um uma dos das do da de e é são no na nos nas para por com que não mais este esta isso se em ao pelo pela como também mas ou foi ser têm muito quando".split(),
    "nl": "de het een en is zijn in van voor op met die dat niet meer dit deze wij hij zij aan door als ook maar of was worden heeft hebben zeer naar bij uit over wanneer geen".split(),
    "cs": "a je jsou v na do se že pro s z to ten ta ne není který která které jako ale nebo když také více po od při být byl jeho její jen už".split(),
}
#: The share of function words from which a text is certainly in its language.
CLEARLY = 0.35
_MORE = {k: frozenset(v) for k, v in MORE_WORDS.items()}
_FOUR = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Scripts by their first and last letters (fixed values of the Unicode blocks).
SCRIPTS = (("cyrillic", 0x0400, 0x052F), ("greek", 0x0370, 0x03FF), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF))
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f\u0590-\u05ff\u0600-\u077f\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_CHARS = {"pl": frozenset("ąćęłńśźż"), "de": frozenset("äöüß"), "es": frozenset("ñ¿¡áíú")}
_LANGS_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _LANGS_OF[_w] = (*_LANGS_OF.get(_w, ()), _lang)

#: Names of the languages that a prompt can ask for.
_NAMES = (
    ("en", r"english|englisch\w*|angielsk\w+|inglés"),
    ("de", r"german|deutsch\w*|niemieck\w+|alemán"),
    ("pl", r"polish|polnisch\w*|polsk\w+|polaco"),
    ("es", r"spanish|spanisch\w*|hiszpańsk\w+|español|castellano"),
    ("fr", r"french|französisch\w*|francusk\w+|francés"),
    ("it", r"italian|italienisch\w*|włosk\w+|italiano"),
    ("pt", r"portuguese|portugiesisch\w*|portugalsk\w+|portugués"),
    ("nl", r"dutch|niederländisch\w*|niderlandzk\w+|neerlandés|holandés"),
    ("cs", r"czech|tschechisch\w*|czesk\w+|checo"),
    ("cyrillic", r"russian|russisch\w*|rosyjsk\w+|ruso|ukrainian|ukrainisch\w*|ukraińsk\w+|ucraniano"),
    ("han", r"chinese|chinesisch\w*|chińsk\w+|chino"),
    ("greek", r"greek|griechisch\w*|greck\w+|griego"),
    ("arabic", r"arabic|arabisch\w*|arabsk\w+|árabe"),
)
_ASK = re.compile(
    r"\b(?:translat\w*|answer|reply|respond|write|put (?:this|it)|say (?:this|it)|przetłumacz\w*|tłumacz\w*|odpowiedz\w*|odpisz|napisz|przełóż|antworte\w*|übersetz\w*|schreib\w*|responde\w*|conteste?\w*|contesta|traduc\w*|traduzca\w*|escrib\w*)\b"
    r"[^.:;!?\n]{0,30}?\b(?:in|into|to|na|po|auf|ins|im|en|al)\s+(?P<name>" + "|".join(n for _, n in _NAMES) + r")\b",
    re.I,
)


def script(text: str) -> str | None:
    """The script of most of a text's letters, if it is another than Latin. Kana tells Japanese from Chinese."""
    if text.isascii():
        return None
    other = _OTHER_SCRIPT.findall(text)
    if not other or 2 * len(other) <= sum(map(str.isalpha, text)):
        return None
    count = Counter(next(name for name, lo, hi in SCRIPTS if lo <= ord(c) <= hi) for c in other)
    return "kana" if count["kana"] else max(count.items(), key=lambda x: (x[1], x[0]))[0]


def language(text: str | None) -> str | None:
    """``en``, ``pl``, ``de``, ``es``, another language, the name of another script, or None where the text doesn't tell."""
    if not text:
        return None
    other = script(text)
    if other:
        return other
    low = text.lower()
    words = Counter(_LETTERS.findall(low))
    score = {"en": 0, "pl": 0, "de": 0, "es": 0}
    for w in words.keys() & _LANGS_OF.keys():
        langs = _LANGS_OF[w]
        for lang in langs:
            score[lang] += words[w] * (6 // len(langs))
    if not low.isascii():
        for lang, chars in _CHARS.items():
            score[lang] += 4 * sum(low.count(c) for c in chars)
    (second, _), (first, best) = sorted((v, k) for k, v in score.items())[-2:]
    told = best if first >= 6 and first >= 1.4 * second else None
    total = sum(words.values())
    if len(words) >= 4 and sum(words[w] for w in words.keys() & _FOUR[best]) < CLEARLY * total:
        four = max(sum(words[w] for w in words.keys() & own) for own in _FOUR.values())
        more, name = max((sum(words[w] for w in words.keys() & own), k) for k, own in _MORE.items())
        if more >= 3 and more >= 1.4 * four and more >= 0.22 * total:
            return name
    return told


def requested(prompt: str | None) -> str | None:
    """The language that a prompt asks for."""
    m = _ASK.search(prompt or "")
    if not m:
        return None
    name = m.group("name").lower()
    return next(lang for lang, pattern in _NAMES if re.fullmatch(pattern, name))


def expected_language(prompt: str | None, locale: str | None) -> str | None:
    return requested(prompt) or language(prompt) or ((locale or "")[:2].lower() or None if prompt and prompt.strip() else None)


# --- refusal -------------------------------------------------------------------------------------------------------

_DECLINE = re.compile(
    r"\b(?:cannot|can['’]?t|can not|could not|couldn['’]?t|won['’]?t|will not|am not able|['’]m not able|am unable|['’]m unable|not (?:permitted|allowed|authori[sz]ed)|must decline|have to decline|need to decline|must refuse|decline to|beyond what i am permitted|no (?:information|answer|details) can be|leave (?:this |it |that )?unanswered|not something i can|do not (?:discuss|answer|provide|give)|don['’]t (?:discuss|answer|provide|give)|refuse to)"
    r"|\bnie (?:mogę|możemy|jestem w stanie|jesteśmy w stanie|wolno mi|udzielam|udzielę|odpowiem|odpowiadam|będę|doradzam|pomogę|potrafię|chcę)\b|muszę odmówić|odmawiam|bez odpowiedzi"
    r"|\b(?:kann|können|darf|dürfen|möchte|werde)\b[^.!?]*\b(?:nicht|nichts|keine?n?)\b|gebe ich nicht|geben wir nicht|muss ich ablehnen|muss (?:leider )?unbeantwortet|lehne ich ab|ist mir nicht (?:gestattet|erlaubt|möglich)|(?:nicht|nichts|keine?n?)\b[^.!?]*\b(?:kann|darf)\b"
    r"|\bno (?:puedo|podemos|podré|me está permitido|se me permite|estoy autorizad\w|doy|ofrezco|respondo|voy a)\b|debo rechazar|tengo que rechazar|rechazo|sin respuesta|me niego",
    re.I,
)
_BESIDE = re.compile(
    r"guidelines?|polic(?:y|ies)|rules do not|is there (?:something|anything) else|anything else|something else|ask (?:a|an) (?:specialist|expert|professional)|consult (?:a|an)|specialist|^(?:i am |i['’]m )?(?:very |so )?sorry[^;:]*$|^(?:unfortunately|thanks|thank you)[^;:]*$|another (?:question|topic)"
    r"|moje zasady|zasad|wytyczn|w czymś innym|specjalist|ekspert|^(?:przykro mi|przepraszam|niestety|dziękuję)[^;:]*$|inne pytanie"
    r"|vorgaben|richtlinien|sonst (?:etwas|noch)|fachkraft|fachmann|expert|^(?:es tut mir leid|tut mir leid|entschuldigung|leider|danke)[^;:]*$|andere frage"
    r"|mis normas|normas|política|otra cosa|algo más|especialista|experto|^(?:lo siento|lamentablemente|por desgracia|disculpe|gracias|perdón)[^;:]*$|otra pregunta",
    re.I,
)
_TURNS = re.compile(
    r"\b(?:but here|here is what|here are|however, here|still, |nevertheless|nonetheless|that said|in general|instead,? (?:here|consider|try))|\bale oto\b|\blecz notatki|\boto, co\b|mimo to|natomiast|jednak oto|doch folgendes|trotzdem|dennoch|hier (?:ist|sind)|pero esto|sin embargo, aquí|aquí (?:tiene|está|van)|aun así|no obstante, ",
    re.I,
)
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”»)*_]*\s+|\n+")
_MARKS = " \t\r\n*_`\"'“”„«»>#~-–—|"


#: Letters without which a sentence neither declines nor accompanies a refusal.
_REFUSING = ahocorasick.Automaton()
for _w in (
    "can", "could", "won", "will", "able", "permitted", "allowed", "authori", "declin", "refus", "information", "answer", "detail", "discuss", "provide", "give", "nie ", "odmówi", "odmawiam", "odpowiedzi", "kann", "könn", "darf", "dürf", "möchte", "werde", "nicht", "kein", "ablehn", "lehne", "gestattet", "erlaubt", "no ", "rechaz", "respuesta", "niego",
    "guideline", "polic", "rules", "something", "anything", "specialist", "expert", "professional", "consult", "sorry", "unfortunately", "thank", "question", "topic", "zasad", "wytyczn", "innym", "specjalist", "ekspert", "przykro", "przepraszam", "niestety", "dziękuję", "pytanie", "vorgaben", "richtlinien", "sonst", "fachkraft", "fachmann", "leid", "entschuldigung",
    "danke", "frage", "normas", "política", "otra", "algo", "especialista", "experto", "siento", "lamentablemente", "desgracia", "disculpe", "gracias", "perdón", "pregunta",
):
    _REFUSING.add_word(_w, 1)
_REFUSING.make_automaton()


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCES.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def declines(text: str) -> bool:
    """Whether a text only declines to answer."""
    refused = False
    for x in _sentences(text):
        s = _SPACE.sub(" ", x).strip(_MARKS)
        if not s:
            continue
        if next(_REFUSING.iter(s.lower()), None) is None:
            return False
        if _TURNS.search(s):
            return False
        if _DECLINE.search(s) and not re.search(r"\d", s):
            said = s.partition(": ")[2]
            if len(said.split()) > 2 and not (_DECLINE.search(said) or _BESIDE.search(said)):
                return False  # "You can't go wrong: ..."
            refused = True
        elif not _BESIDE.search(s):
            return False
    return refused


# --- empty ---------------------------------------------------------------------------------------------------------

_TAGS = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-f]+|zwnj|zwj);", re.S | re.I)
_INVISIBLE = re.compile("[\\u00ad\\u034f\\u180e\\u200b-\\u200f\\u2028-\\u202e\\u2060-\\u206f\\ufeff\\u00a0]")
_FENCE = re.compile(r"^\s*(?:```|~~~)\s*[\w+-]*\s*$", re.M)
#: Stand-ins for nothing, without marks.
STAND_INS = frozenset(
    "null|none|nil|nan|undefined|na|n a|n/a|n.a|empty|blank|void|tbd|no answer|no response|no content|no data|no text|not available|not applicable|nothing|missing|placeholder|error|true|false"
    "|brak|brak danych|brak odpowiedzi|brak treści|nie dotyczy|puste|nic|nd|n.d|keine angabe|keine antwort|keine angaben|kein inhalt|keine daten|k.a|leer|entfällt|nicht verfügbar|sin datos|sin respuesta|sin contenido|vacío|no disponible|no aplica|ninguno|nada|s/d".split("|")
)


def is_empty(text: str | None) -> bool:
    if not text or not text.strip():
        return True
    s = _INVISIBLE.sub("", _FENCE.sub("", _TAGS.sub(" ", text)))
    words = re.findall(r"\w+", s.replace("_", " "))
    if not words:
        return True
    return len(s) <= 40 and _SPACE.sub(" ", s).strip(" \t\r\n.!?-–—()[]{}<>\"'`*_|/\\~:;,").lower() in STAND_INS


# --- copy ----------------------------------------------------------------------------------------------------------

_LABEL = re.compile(r"^\W*(?:question|you asked|your question|the question|prompt|user|query|request|q|pytanie|zapytanie|twoje pytanie|użytkownik|frage|ihre frage|sie fragten|sie haben gefragt|anfrage|nutzer|pregunta|su pregunta|usted preguntó|consulta|usuario)\s*[:>-]+\s*", re.I)


def copies(text: str, prompt: str | None) -> bool:
    """Whether a text only repeats the prompt."""
    if not prompt:
        return False
    want = [w.lower() for w in _WORDS.findall(prompt)]
    if not want:
        return False
    body = _LABEL.sub("", text.strip())
    heads = {m.group(0).lower() for m in (_WORDS.search(body), _WORDS.search(text)) if m}
    if not any(h == want[0] for h in heads):
        return False
    for candidate in (body, text):
        have = [w.lower() for w in _WORDS.findall(candidate)]
        if len(have) >= len(want) and len(have) % len(want) == 0 and have == want * (len(have) // len(want)):
            return True
        if 4 <= len(have) < len(want) and len(have) >= 0.7 * len(want) and want[: len(have) - 1] == have[:-1] and want[len(have) - 1].startswith(have[-1]):
            return True
    parts = [p for p in (_LABEL.sub("", x).strip() for x in text.split("\n")) if p]
    return len(parts) > 1 and all([w.lower() for w in _WORDS.findall(p)] in (want, []) for p in parts)


# --- truncated -----------------------------------------------------------------------------------------------------

_ITEM_LINE = re.compile(r"^\s*(?:[-*•·▪–+]|\(?\d{1,3}[.)])\s+(?=\S)")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+$|^\[\d+\]:?\s|\S+@\S+\.\w+$", re.I)
_CLOSERS = " \t\r\n\"'”“’»›)]*_`~}"


def item_text(line: str) -> str:
    return _SPACE.sub(" ", _ITEM_LINE.sub("", line)).strip(" \t*_`.,;:").lower()


def _listed(lines: list[str]) -> list[str]:
    return [item_text(x) for x in lines if _ITEM_LINE.match(x) and len(x.split()) <= WORDS + 1]


def bare_items(text: str) -> list[str] | None:
    """The items of an answer that consists of items only: one line of a few words, or several parted by commas."""
    s = text.strip()
    if "\n" in s or s[-1:] in ".!?…":
        return None
    items = [x.strip().lower() for x in re.split(r",|;| / ", s)]
    if not all(items) or any(len(x.split()) > 4 for x in items):
        return None
    return [_SPACE.sub(" ", x) for x in items]


_NO_BRACKET = re.compile(r"(?:```|~~~).*?(?:```|~~~)|`[^`\n]*`|https?://\S+|[:;=]-?[(\[{]", re.S)


def unclosed(text: str) -> bool:
    """Whether the last paragraph opens a bracket or a quotation mark that it doesn't close."""
    part = _NO_BRACKET.sub(" ", text).rstrip().rsplit("\n\n", 1)[-1]
    if any(part.count(a) > part.count(b) for a, b in ("()", "[]", "{}")):
        return True
    if part.count("„") > part.count("”") + part.count("“") + part.count('"'):
        return True
    if "„" not in part and part.count("“") > part.count("”"):
        return True
    if part.count("«") > part.count("»") and "»" not in part:
        return True
    return part.count('"') % 2 == 1 and re.search(r'(?:^|[\s(])"\w[^"]*$', part) is not None


def ending(text: str) -> tuple[str, str | None]:
    """``("cut" | "whole" | "item", last item)``: how a text ends; an item is decided by the lexicon."""
    if len(re.findall(r"^\s*(?:```|~~~)", text, re.M)) % 2:
        return "cut", None
    lines = [x for x in text.rstrip().split("\n") if x.strip()]
    last = lines[-1].strip()
    if re.match(r"(?:```|~~~)", last):
        return "whole", None
    listed = bool(_ITEM_LINE.match(last))
    core = last.rstrip(_CLOSERS)
    if core.endswith(("...", "…", ",", ";", "(", "[", "{", " -", " –", " —", "/", ":")) and not _ADDRESS.search(last):
        return "cut", None
    if core.endswith((".", "!", "?", "。")):
        return ("cut" if unclosed(text) else "whole"), None
    if not core:
        return "cut" if last[-1:] in "([{" else "whole", None
    if _ADDRESS.search(last) or (last[:1] == "|" and last[-1:] == "|") or last[-1:] == ">":
        return "whole", None
    if listed:
        words = len(item_text(last).split())
        if words <= 5:
            return "item", item_text(last)
        return ("cut" if any(x.strip().endswith((".", "!", "?")) for x in lines if _ITEM_LINE.match(x)) else "whole"), None
    if len(lines) == 1:
        items = bare_items(last)
        if items is not None:
            return "item", items[-1]
        return "cut", None
    return "cut", None


# --- pairs ---------------------------------------------------------------------------------------------------------

_CODE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)|https?://\S+", re.S)


def certain_defects(text: str | None, refusal: str | None, prompt: str | None) -> list[str]:
    """The defects that need neither a language nor the lexicon."""
    out = []
    t = text or ""
    if (refusal and refusal.strip()) or declines(t):
        out.append("refusal")
    if is_empty(text):
        out.append("empty")
    elif copies(t, prompt):
        out.append("copy")
    return out


_ROWS = "run string, prompt string, run_index int, defects array<string>, want string, items array<string>, tail string, word string, lang string, uses bigint"


def judged(pairs: DataFrame) -> DataFrame:
    """One row for each pair ``(run, prompt, run_index, text, refusal, ptext, locale)``, with its defects so far and what
    the lexicon has to decide; and rows of the lexicon (``word, lang, uses``), counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Counter[tuple[str, str]] = Counter()
        wants: dict[tuple, str | None] = {}

        def rows(data: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                k: pa.array([r.get(k) for r in data], t)
                for k, t in (("run", pa.string()), ("prompt", pa.string()), ("run_index", pa.int32()), ("defects", pa.list_(pa.string())), ("want", pa.string()), ("items", pa.list_(pa.string())), ("tail", pa.string()), ("word", pa.string()), ("lang", pa.string()), ("uses", pa.int64()))
            })

        for b in chunks(batches):
            out = []
            for r in b.to_pylist():
                text, prompt = r["text"], r["ptext"]
                row = {"run": r["run"], "prompt": r["prompt"], "run_index": r["run_index"], "defects": certain_defects(text, r["refusal"], prompt), "want": None, "items": None, "tail": None}
                out.append(row)
                if "empty" in row["defects"]:
                    continue
                key = (prompt, r["locale"])
                if key not in wants:
                    if len(wants) > 50_000:
                        wants.clear()
                    wants[key] = expected_language(prompt, r["locale"])
                want = wants[key]
                plain = _CODE.sub(" ", text)
                lines = plain.split("\n")
                listed = _listed(lines)
                prose = "\n".join(x for x in lines if not _ITEM_LINE.match(x)) if listed else plain
                lang = language(prose)
                how, tail = ending(text)
                bare = bare_items(text)
                if bare is not None:
                    row["items"], row["want"] = bare, want
                elif lang is None and listed:
                    row["items"], row["want"] = listed, want
                elif lang and want and lang != want:
                    row["defects"].append("language")
                if how == "cut":
                    row["defects"].append("truncated")
                elif how == "item":
                    row["tail"] = tail
                if lang and listed:
                    whole = listed[:-1] if how == "item" and bare is None else listed
                    lexicon.update((x, lang) for x in whole if x)
            yield rows(out)
            if len(lexicon) > 100_000:
                yield rows([{"word": w, "lang": g, "uses": n} for (w, g), n in lexicon.items()])
                lexicon.clear()
        if lexicon:
            yield rows([{"word": w, "lang": g, "uses": n} for (w, g), n in lexicon.items()])

    cols = ("run", "prompt", "run_index", "text", "refusal", "ptext", "locale")
    return pairs.select(*cols).mapInArrow(run, _ROWS)


def with_prompts(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """Answers with the text and locale of their prompt; of several texts of one prompt the smallest counts."""
    p = prompts.where(F.col("prompt").isNotNull()).groupBy("prompt").agg(F.min(F.struct("text", "locale")).alias("p")).select("prompt", F.col("p.text").alias("ptext"), F.col("p.locale").alias("locale"))
    return answers.select("run", "prompt", "run_index", "text", "refusal").join(p, "prompt", "left")


def defects(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """``run, prompt, run_index, defects``: every triggered defect of each defective pair, in the order of the rules."""
    all_rows = cut(judged(with_prompts(answers, prompts)), "pairs")
    pairs = all_rows.where("word is null").select("run", "prompt", "run_index", "defects", "want", "items", "tail").distinct().withColumn("pid", F.xxhash64("run", "prompt", "run_index", "defects", "want", "items", "tail"))
    uses = all_rows.where("word is not null").groupBy("word", "lang").agg(F.sum("uses").alias("uses"))
    best = uses.groupBy("word").agg(F.max(F.struct("uses", "lang")).alias("m"), F.sum("uses").alias("n")).where(F.col("n") >= KNOWN)
    lexicon = best.select("word", F.when(F.col("m.uses") > 0.8 * F.col("n"), F.col("m.lang")).alias("lang"), "n")
    begins = lexicon.where(F.length("word") > 1).select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"), "word").select(F.expr("substring(word, 1, k)").alias("tail")).distinct().withColumn("begins", F.lit(True))

    open_pairs = pairs.where("items is not null or tail is not null")
    by_items = (
        open_pairs.where("items is not null and want is not null").select("pid", "want", F.explode("items").alias("word"))
        .join(lexicon.select("word", "lang"), "word").where("lang is not null")
        .groupBy("pid", "want").agg(F.count(F.when(F.col("lang") == F.col("want"), 1)).alias("right"), F.count("*").alias("told"))
        .where("told > 2 * right").select("pid", F.lit("language").alias("defect"))
    )
    by_tail = (
        open_pairs.where("tail is not null").select("pid", "tail", "items")
        .join(lexicon.select(F.col("word").alias("tail"), F.lit(True).alias("known")), "tail", "left_anti")
        .join(begins, "tail", "left")
        .where(F.coalesce("begins", F.lit(False)) | (F.col("items").isNotNull() & (F.size("items") == 1) & (F.size(F.split("tail", " ")) >= 3)))
        .select("pid", F.lit("truncated").alias("defect"))
    )
    told = by_items.unionByName(by_tail).groupBy("pid").agg(F.collect_set("defect").alias("more"))
    every = F.concat("defects", F.coalesce("more", F.array().cast("array<string>")))
    ranked = F.filter(F.array(*map(F.lit, ORDER)), lambda d: F.array_contains(every, d))
    return pairs.join(told, "pid", "left").select("run", "prompt", "run_index", ranked.alias("defects")).where(F.size("defects") > 0)


def found(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    return defects(answers, prompts).select("run", "prompt", "run_index", F.col("defects")[0].alias("defect")).distinct()
