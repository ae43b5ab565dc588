"""Problem 1: template residue, filler, error messages and script notices in place of content.

Every line of a text (and every title) is a message. Its numbers, addresses and dates are masked and white space is
normalised, so that the same message from many pages is one string, and it gets features by rules:

* placeholder rules find unfilled template fields in any of the usual delimiters, and values that a template failed to
  fill (``undefined``, ``NaN``, ``Invalid Date``, ``[object Object]``); a sentence that explains templates is no case;
* phrase rules read the words of a message as classes (what failed, what it happened to, a denial, an apology, advice, scripts
  and what to do with them, waiting, calls to fill in a text, words for unwritten text). A message fits if its classes
  combine (a failure and an object, a denial and a state, ...) and cover it: a real sentence about such things has words of
  its own. Running filler text is recognised by the share of its words in the filler vocabulary;
* messages are grouped by their exact masked form over all sources and rows. A message whose classes combine and cover
  ``CERTAIN`` of its words is a case wherever it stands; one that is covered less, or has only a weak cue (a word such as
  "error"), is a case only if it recurs in at least ``MIN_SOURCES`` sources. In a longer text, list items and headings of one
  or two words are no weak messages.

Shuffles carry flagged messages only, never texts. Defined cases: null, empty and blank texts give nothing; JSON that
doesn't parse or has another shape gives nothing; rows are distinct.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, spread

#: Sources in which a message that its words don't settle must recur.
MIN_SOURCES = 3
#: The share of its content words that classes must cover: of a message that is a case wherever it stands; the
#: same of one on scripts that addresses nobody; of one that must recur.
CERTAIN, SCRIPTS, LIKELY = 0.7, 0.8, 0.5
#: Characters of a message that are kept as they are; the rest is kept as a hash.
KEPT = 200
#: Words of a line with a weak cue in a longer text.
LEAST_WORDS = 3

_NAME = r"[A-Za-z_][\w.\- ]*"
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[#/>&]?\s*" + _NAME + r"(?:\|[^{}]*)?\s*\}?\}\}"
    r"|\{%[-+]?\s*" + _NAME + r"[^%{}]*%\}"
    r"|<%[=\-@#]?\s*" + _NAME + r"[^%<>]*%>"
    r"|<\?(?:=|php)\s*(?:echo\s+)?\$?" + _NAME + r"[^<>?]*\?>"
    r"|[$#]\{\s*" + _NAME + r"\}"
    r"|@@\s?[A-Za-z][\w.\-]*\s?@@"
    r"|__[A-Za-z][A-Za-z0-9.\-]*(?:_[A-Za-z0-9.\-]+)*__"
    r"|\[\[\s*[A-Za-z][\w.\-]*\s*\]\]"
    r"|(?<![\w%])%[A-Za-z][\w.\-]+%(?![\w%])"
    r"|(?<![\w$])\$[A-Za-z][\w.\-]+\$(?![\w$])"
    r"|(?<![\w\]])\[[A-Za-z][\w.\-]+\](?![\w(\[])"
    r"|(?<![\w${#])\{[A-Za-z][\w.\-]+\}(?![\w}])"
    r"|[\[<](?i:insert|enter|your|add|type|wpisz|wstaw|twoj[ea]|podaj|ihr|ihre|hier|inserte|escriba|su|votre)\s[^\[\]<>]*[\]>]"
)
UNFILLED = re.compile(r"\bNaN\b|\b[Ii]nvalid [Dd]ate\b|\bINVALID DATE\b|\[object Object\]|\[OBJECT OBJECT\]|\bundefined\b|\bnull null\b|\bnull \||\| null\b|\bNAN (?:EUR|ZŁ|USD|PLN)\b|(?:HELLO|HALLO|WITAJ|HOLA|ONLY|NOCH|ZOSTAŁO:?|QUEDAN|SOLO) UNDEFINED\b")
#: A sentence about templates or code: one field or value in it is an example.
_ABOUT = re.compile(
    r"template|szablon|vorlage|plantilla|\bletter\b|mail tool|mailing|im brief|\bbrief steht|programm?a?\b|la carta|\bvariable|zmienn|\bsyntax|\bfunction|funkcj|funktion|función"
    r"|\b(?:stays?|remains?|is|are|was|be|left|returns?|bleibt|ist|pozostaje|jest|queda|sigue|es) undefined|example|przykład|beispiel|ejemplo|how to fix",
    re.I,
)
BAD_ADDRESS = re.compile(
    r"(?:%7B){1,3}|\{\{|\$\{|#\{|%24%7B|<%|%3C%|\{[A-Za-z_]|/:[A-Za-z_]\w*(?=[/?#]|$)|%5Bobject|\[object|%(?![0-9A-Fa-f]{2})[A-Za-z_]\w*%|%[A-Z_]{3,}%|__[A-Za-z]\w*__|@@\w+@@|\[\[|%5B%5B|\$[A-Za-z_]\w*\$"
    r"|[/=](?:undefined|null|NaN|none|nil)(?=[/?#&.]|$)",
    re.I,
)

#: Words of running filler text (fixed values of the customary filler).
FILLER_WORDS = frozenset(
    "ad adipiscing aliqua aliquam aliquet aliquip amet ante arcu at auctor augue aute bibendum blandit cillum commodo condimentum congue consectetur"
    " consequat convallis cras cupidatat curabitur cursus dapibus deserunt diam dictum dignissim dis dolor dolore donec duis efficitur egestas eget eiusmod elementum"
    " eleifend elit enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis faucibus felis fermentum feugiat finibus fringilla fugiat"
    " fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris lacinia lacus laoreet lectus leo libero"
    " ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris maximus metus minim molestie mollis morbi nam nec neque nibh nisi nisl non nostrud nulla"
    " nullam nunc odio officia orci ornare pariatur pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident proin pulvinar purus"
    " quam quis quisque reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit suspendisse tellus"
    " tempor tempus tincidunt tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula vel velit venenatis veniam vestibulum vitae vivamus viverra"
    " voluptate volutpat vulputate".split()
)

#: Classes of words by their stems: a stem with ``$`` is a whole word.
CLASSES: dict[str, str] = {
    # what went wrong, by itself
    "fail": "error$ errors$ fatal exception fail$ failed failure denied forbidden prohibited blocked unavailable expire timeout$ timed$ missing$ invalid refused unauthori overload interrupted rejected suspended outage wrong$ gone$ down$ oops whoops gateway$ maintenance offline$"
    " błąd$ błęd awari odmow zabronion zablokowan niedostępn wygas nieprawidłow przerw konserwac prac$ prace$ ups$ przeciążon nieautoryzowan przekroczono nieudan"
    " fehler$ fehlgeschlagen verweigert abgelehnt verboten blockiert abgelaufen ungültig schiefgelaufen schiefgegangen wartung wartungsarbeiten hoppla überlastet gestört störung serverfehler datenbankfehler zeitüberschreitung fehlt$"
    " fallo$ fallid denegad prohibid bloquead caducad expirad inválid rechazad mantenimiento vaya$ mal$ agotad interrumpid saturad"
    " erreur échoué échec refusé interdit indisponible expiré introuvable désolé errore fallito negato vietato scaduto fout mislukt geweigerd",
    # what it happened to
    "object": "page internal$ site website server service resource content request session connection database access address url$ link$ file$ document$ application app$ account$ permission privilege rights$ host$ login$ query$ http$ https$ status$ system$ network upstream proxy security"
    " wewnętrzn techniczn żądani zapytań stron serwis serwer usług zasób zasob treś żądan zapytan sesj połączeni baz$ bazy$ bazą$ danych$ dostęp adres link plik dokument aplikacj konto$ uprawnie witryn zgłosze"
    " interner$ seite dienst server ressource inhalt anfrage sitzung verbindung datenbank zugriff adresse datei dokument anwendung konto$ berechtigung webseite website vorgang"
    " interno$ página sitio servicio servidor recurso contenido solicitud petición peticiones solicitudes sesión conexión acceso dirección enlace archivo documento aplicación cuenta$ permiso web$ datos$ base$"
    " site$ demande ressource accès serveur pagina sito pagine risorsa",
    "deny": "too$ not$ no$ cannot$ cant$ couldn$ couldnt$ can$ isn$ isnt$ doesn$ doesnt$ don$ won$ wasn$ unable$ without$ never$ longer$ many$ unexpected bad$ t$"
    " nie$ brak$ nieoczekiwan już$ zbyt$ wiele$ nicht$ kein keine mehr$ nichts$ viele$ unerwartet no$ sin$ demasiad inesperad ya$ ne$ pas$ plus$ non$ niet$ geen$",
    "state": "found$ find$ available exist reach$ reached reachable load$ loaded display open$ opened authori permitted allowed shown$ show$ connect$ connected establish work$ working process complete handle displayed located removed moved deleted changed going$ missing view$ viewing accessible supported access$ retriev serve$ respond"
    " znale odnale istniej dostępn masz$ wyświetl otworzy połączy załadow działa przenies usunięt zmieni możn moż udało uda$ jest$ poszło$"
    " gefunden finden existiert verfügbar erreichbar geladen angezeigt anzuzeigen berechtigt erlaubt verbinden hergestellt verschoben gelöscht geändert gibt$ vorhanden aufgetreten werden$"
    " encontr existe disponible accesible carg mostr abrir$ autorizad permitid conectar establec movid eliminad cambiad salió$ ido$ ocurrid producid pudo$ puede$ busca$ acced"
    " trouvée trouvé existe disponible peut$ trovata disponibile esiste gevonden beschikbaar bestaat",
    "moved": "removed moved deleted taken$ usunięt przenies skasowan verschoben gelöscht entfernt movid eliminad retirad borrad supprim rimoss",
    "sorry": "sorry$ please$ apolog unfortunately$ regret something$ somewhat$ przepraszam przykro niestety coś$ proszę$ leider$ bitte$ entschuldig etwas$ verzeihung lamentamos sentimos$ disculp por$ favor$ algo$ désolé malheureusement spiacenti helaas excuseer",
    "advice": "try$ retry again$ later$ reload refresh back$ return$ home$ homepage start$ startpage contact administrator admin$ owner webmaster helpdesk support$ reference$ incident number$ code$ codes$ check$ persist few$ minutes$ minute$ moment moments$ soon$ shortly$ ticket$ go$ meanwhile write$ mistyped spelling temporarily$ temporary scheduled currently$ right$ now$ here$ e$ requested$ looking$ occurred$ looks$ may$ might$ have$ has$ be$"
    " spróbuj ponownie później odśwież wróć wstecz startow główn administrator właściciel kontakt numer kod$ kod minut kilka$ chwil sprawdź tymczasow chwilowo$ zaplanowan wkrótce$ mógł$ mogła$ razie$ być$ może$"
    " versuchen versuch erneut später neu$ zurück startseite administrator betreiber kontakt referenznummer vorgangsnummer nummer code$ minuten moment augenblick prüfen vorübergehend geplant derzeit momentan hat$ sich$ vielleicht$ möglicherweise einigen$ wegen$"
    " inténtelo inténtalo intente intentar nuevo$ más$ tarde$ recargue recargar actualice volver vuelva inicio$ administrador propietario contacte número referencia código minutos unos$ momento compruebe temporalmente programad actualmente haya$ pued puede$"
    " réessay veuillez plus tard riprova ripeti",
    "script": "javascript$ js$ script$ scripts$ browser adblock skrypt skrypty skryptów przeglądark skript skripte skripten navegador navigateur scripting",
    "switch": "checking verifying sprawdzamy weryfikac weryfikuj überprüft geprüft comprobando verificando enable activat turn$ turned$ switch on$ off$ disable deactivat require need must$ block blocks$ support allow run$ runs$ reload them$ nothing$ upgrade update outdated"
    " włącz wyłącz wymaga potrzebuj musi musisz blokuj obsług odśwież aktywuj zaktualizuj aby$ zobaczyć$"
    " aktivier deaktiviert ausgeschaltet einschalten eingeschaltet schalten benötigt braucht blockiert unterstützt aktualisier muss$ müssen um$ sehen$ sehen"
    " active$ activ actív actívelos desactivad habilit deshabilit necesita requiere bloquea admite soporta actualic debe$ para$ ver$ ejecut nada$"
    " activez activer désactivé attiva abilita",
    "wait": "loading$ wait$ redirecting preparing$ fetching$ buffering ładowani ładuje wczytyw czekać czekaj przekierow lädt$ geladen$ warten$ weiterleitung cargando$ espere$ redirigiendo chargement patientez caricamento attendere human$ człowiek mensch humano trwa$",
    "fill": "insert add$ enter$ type$ click replace paste edit$ goes$ put$ fill$ customi describe$ wpisz wstaw kliknij edytow uzupełni podmian podmień dodaj zastąp wklej einfügen eingeben klicken bearbeiten ersetzen steht$ hinzufügen ausfüllen auszufüllen tippen inserte insertar inserta escriba añad haga$ haz$ clic$ editar$ va$ cámbi sustitu rellen reemplac redactar complet insérez saisissez cliquez modifier inserisci",
    "part": "text$ title$ headline heading paragraph content$ copy$ description caption$ subtitle body$ name$ here$ your$ launch$ before$ company$ image$ tekst treś tytuł nagłów akapit opis tu$ tutaj$ swój$ twój$ nazwa nazwę text titel überschrift absatz inhalt$ beschreibung hier$ ihr$ ihre$ ihren$ diesen texto título titular párrafo contenido descripción aquí$ su$ tu$ este$ texte titre votre ici$ testo titolo qui$",
    "unwritten": "uzupełnieni placeholder dummy$ sample$ todo$ tbd$ tba$ untitled lorem$ ipsum$ construction$ coming$ soon$ follow$ follows$ written$ unwritten draft$ zastępcz przykładow przygotowani budowie$ budow wkrótce$ szkic bez$ platzhalter beispieltext mustertext folgt$ aufbau$ ohne$ entwurf vorbereitung muestra$ provisional próximamente preparación construcción ejemplo$ pendiente$ borrador sin$ desarrollo$ segnaposto",
    "you": "twoją$ twojej$ twoim$ państwa$ tego$ tym$ tych$ dem$ dieses$ you$ your$ this$ if$ twoja$ twoje$ twój$ ta$ tej$ ten$ ihr$ ihre$ diese dieser dieses sie$ su$ sus$ tu$ esta$ este$ esto$ votre cette",
    "we": "we$ our$ us$ it$ that$ wir$ uns$ nos$ nosotros$ nas$ nous$",
}
#: Words that carry nothing here.
_EMPTY = frozenset(
    "a an the of to in on at by for from with and or as is are was were be been so but have has had do does did will would there which when while until after its what i w z na do się sie to że o po lub albo oraz jest są był zostało została został masz mam mamy za od dla ze der die das den dem des ein eine einen und oder zu zum zur im auf an von mit ist sind war es wurde wird worden auch haben habe hat el la los las un una de del en y o que se al es son lo le ha han le les du un une et ou il lo la gli di che e è een het de van".split()
)
_STEMS: dict[str, dict[str, list[str]]] = {}
_WHOLES: dict[str, frozenset[str]] = {}
for _kind, _text in CLASSES.items():
    for _stem in _text.split():
        if _stem.endswith("$"):
            _WHOLES[_stem[:-1]] = _WHOLES.get(_stem[:-1], frozenset()) | {_kind}
        else:
            _STEMS.setdefault(_stem[:2], {}).setdefault(_stem, []).append(_kind)
#: Classes that make a line worth reading, and the shortest of their words.
_TELLING = ("fail", "script", "wait", "unwritten", "fill", "sorry", "deny", "advice")


@lru_cache(maxsize=200_000)
def word_classes(word: str) -> frozenset[str]:
    """The classes of a word in lower case: of its whole form and of all stems that it begins with."""
    out = set(_WHOLES.get(word, ()))
    for stem, kinds in _STEMS.get(word[:2], {}).items():
        if word.startswith(stem) and len(word) <= len(stem) + 5:
            out.update(kinds)
    return frozenset(out)


_WEAK = re.compile(
    r"error|failed|denied|blocked|unavailable|expired|not found|loading|please wait|maintenance|scripts?\b|javascript|browser|try again|placeholder|błąd|niedostępn|zablokowan|wygasł|ładowani[eu]\b|podczas ładowania|wczytyw|skrypt|przeglądark|spróbuj|fehler|verweigert|blockiert|abgelaufen|nicht verfügbar|geladen|skripte|wartung"
    r"|denegado|bloquead|caducad|no disponible|cargando|mantenimiento|navegador|inténte|coming soon|przygotowani|folgt|preparación|edit\b|edytować|bearbeiten|editar",
    re.I,
)
#: Letters without which no weak cue can be: the alternatives up to their first sign of a pattern.
_WEAK_LETTERS = ahocorasick.Automaton()
for _w in _WEAK.pattern.split("|"):
    _WEAK_LETTERS.add_word(re.match(r"[^\\\[?]+", _w.replace("s?", "")).group(0), 1)
_WEAK_LETTERS.make_automaton()
#: Words that name the subject of a title rather than what went wrong.
_TECHNIQUE = re.compile(r"scripts?\b|javascript|browser|skrypt|przeglądark|skripte|navegador", re.I)
_NUMBER = re.compile(r"\d+")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+", re.I)
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_END = re.compile(r"[.!?…]+\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_ONLY_STATUS = re.compile(r"^\W*(?:error|fehler|błąd|http)?\W*(?:400|401|403|404|410|429|500|502|503|504)\W*$", re.I)
_KEYS = re.compile(r"^(?:(\w)\1{2,}\s+){1,}(\w)\2{2,}$|^(asdf|qwerty|test|bla|blah)(?:\s+\3){1,}\W*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•·▪–+]|\(?\d{1,3}[.)])\s")
_LEAD = "«»\"'“”„‘’ *•-–—·#>|"


def mask(line: str) -> str:
    """The message with addresses, dates and numbers masked and white space normalised."""
    s = _ADDRESS.sub("@", line) if ("@" in line or "://" in line or "www." in line) else line
    return _SPACE.sub(" ", _NUMBER.sub("0", _DATE.sub("0", s))).strip()


#: A cheap test that most texts fail: a character or word of a field rule.
_FIELD_CUE = re.compile(r"[{}<@%$\[_]|undefined|NaN|nvalid|null|NULL|UNDEFINED|NAN ")
#: Messages that are also ordinary words of a list: they count only in texts without running text.
_AMBIGUOUS = frozenset(("seitentitel", "page title", "tytuł strony", "título de la página", "placeholder", "platzhalter"))
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_STATUS = re.compile(r"(?<!\d)(?:4[0-5]\d|50[0-9]|51[01]|52\d)(?!\d)")


def filler_share(line: str) -> tuple[int, float]:
    words = [w.lower() for w in _WORD.findall(line)]
    return len(words), sum(w in FILLER_WORDS for w in words) / max(len(words), 1)


def field_kind(line: str) -> str | None:
    """``placeholder`` or ``unfilled`` if a sentence of the line holds such a value other than as an example."""
    if not (PLACEHOLDER.search(line) or UNFILLED.search(line)):
        return None
    for s in _SENTENCE.split(line):
        fields, values = len(PLACEHOLDER.findall(s)), len(UNFILLED.findall(s))
        if not fields + values or (fields + values == 1 and _ABOUT.search(s)):
            continue
        return "placeholder" if fields else "unfilled"
    return None


#: Words that are also headings of real content, alone.
_HEADINGS = frozenset("error errors fehler errores błąd błędy errore errori erreurs fallos wartung maintenance mantenimiento konserwacja".split())
#: What parts the items of a menu: "Home | Contact" advises nothing.
_PARTED = re.compile(r"\s[|›»>/·•–—-]\s|[|›»·•]")


def sentence_kind(words: list[str], status: bool = False) -> tuple[str | None, float, bool]:
    """The kind of message that the classes of a sentence's words combine to, the share of its content words that they cover,
    and whether it addresses the reader. ``status``: the sentence holds a number that is a status code."""
    of = [word_classes(w) for w in words]
    told = sum(map(bool, of))
    content = told + sum(1 for w, c in zip(words, of) if not c and w not in _EMPTY)
    if not told or told < LIKELY * content:
        return None, 0.0, False
    have, whole = frozenset().union(*of), told == content

    def count(name: str) -> int:
        return sum(name in c for c in of)

    kind = None
    if "script" in have and ("switch" in have or "fail" in have):
        kind = "script"
    elif "wait" in have and (have & {"sorry", "object", "script", "you", "we", "advice"} or whole):
        kind = "script"
    elif "fill" in have and "part" in have and count("fill") + count("part") > (1 if len(words) <= 4 else 2):
        kind = "filler"
    elif "unwritten" in have and (have & {"part", "object", "fill"} or whole) and "fail" not in have:
        kind = "filler"
    elif status and have & {"object", "fail", "state"}:
        kind = "error"
    elif whole and not status and len(words) == 1 and words[0] in _HEADINGS:
        kind = None
    elif "fail" in have and (have & {"object", "deny", "sorry", "advice", "you", "we", "state"} or whole):
        kind = "error"
    elif "deny" in have and (("state" in have and have & {"object", "sorry", "you", "we"}) or ("object" in have and whole)):
        kind = "error"
    elif "moved" in have and "object" in have and have & {"you", "sorry", "deny"}:
        kind = "error"
    elif whole and count("advice") >= 2:
        kind = "advice"
    return kind, told / content, bool(have & {"you", "sorry"})


def phrase_kind(line: str) -> tuple[str | None, bool]:
    """The kind of the message that a line is (or begins with, followed by others), and whether its words settle it."""
    s = line.strip(_LEAD)
    end = _END.search(s)
    while end and not _WORD.search(s, 0, end.start()):  # "404." or "!!!" is no sentence of its own
        end = _END.search(s, end.end())
    first = s[: end.start()] if end else s
    words = [w.lower() for w in _WORD.findall(first)]
    if end and len(words) <= 2:  # "Sorry!" says nothing yet
        after = _END.search(s, end.end())
        first = s[: after.start()] if after else s
        words = [w.lower() for w in _WORD.findall(first)]
    if not words:
        return None, False
    kind, cover, addressed = sentence_kind(words, bool(_STATUS.search(first)))
    if kind == "advice":
        kind = None if _PARTED.search(first) else "error"
    if kind is None or cover < LIKELY:
        return None, False
    if kind == "script":  # or a real sentence on the technique
        return (kind, True) if cover >= (CERTAIN if addressed else SCRIPTS) else (None, False)
    return kind, cover >= CERTAIN


def line_kind(line: str, fields: bool = True) -> tuple[str | None, bool]:
    """The kind of residue in one line, or None, and whether it is certain without recurring. ``fields``: the line may hold
    template fields."""
    kind = field_kind(line) if fields and _FIELD_CUE.search(line) else None
    if kind:
        return kind, True
    if _ONLY_STATUS.match(line):
        return "error", True
    bare = line.strip(_LEAD + ".")
    if bare in ("null", "undefined", "NaN", "None", "nil", "NULL", "UNDEFINED"):
        return "unfilled", True
    if bare.lower() in _AMBIGUOUS or _KEYS.match(bare):
        return "filler", True
    head = _WORD.search(bare)
    if head and head.group(0).lower() in FILLER_WORDS:
        n, share = filler_share(line)
        if (n >= 4 and share >= 0.75) or (n >= 2 and share == 1 and "lorem" in line.lower()):
            return "filler", True
    return phrase_kind(line)


def text_messages(text: str | None) -> list[tuple[str, str, bool]]:
    """``(masked message, kind, certain)`` for each flagged line of a text."""
    if not text or text.isspace():
        return []
    out, unsure = [], []
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    fields = _FIELD_CUE.search(text) is not None
    for line in lines:
        kind, certain = line_kind(line, fields)
        if kind:
            if kind in ("filler", "error", "script") and _ITEM.match(line):
                continue
            (unsure if line.strip(_LEAD).lower() in _AMBIGUOUS else out).append((_key(mask(line)), kind, certain))
    if unsure and (out or not any(_prose(x) for x in lines)):
        out += unsure
    return out


def _prose(line: str) -> bool:
    return line.rstrip()[-1:] in ".!?…" and len(_WORD.findall(line)) >= 8


def _parts(title: str) -> list[str]:
    """A title, and what stands before and behind a separator."""
    parts = [title]
    for sep in (" | ", " - ", " – ", " · "):
        if sep in title:
            parts += [title.rsplit(sep, 1)[0], title.split(sep, 1)[1]]
    return parts


def _title_of(diff: str) -> str | None:
    """The rendered title of a difference, the raw one if there is none."""
    try:
        j = json.loads(diff)
    except ValueError:
        return None
    if not isinstance(j, dict):
        return None
    title = j.get("renderedTitle")
    if title is None:
        title = j.get("rawTitle")
    return title if isinstance(title, str) else None


def title_messages(title: str | None) -> list[tuple[str, str, bool]]:
    """As ``text_messages`` for a title, which may carry a site name behind or before a separator."""
    if not title or not title.strip():
        return []
    likely = []
    for p in _parts(title):
        kind, certain = line_kind(p)
        if kind and certain:
            return [(_key(mask(p)), kind, True)]
        if kind:
            likely.append((_key(mask(p)), kind, False))
    return likely[:1]


def _key(masked: str) -> str:
    """A masked message, the end of a long one as its hash."""
    return masked if len(masked) <= KEPT else f"{masked[:KEPT]} {xxhash.xxh3_64_hexdigest(masked)}"


def _weak(s: str) -> bool:
    return next(_WEAK_LETTERS.iter(s.lower()), None) is not None and _WEAK.search(s) is not None


def weak_lines(text: str | None) -> list[tuple[str, str, bool]]:
    """As ``text_messages``: the lines of a text that have a weak cue, at any length."""
    if not text or next(_WEAK_LETTERS.iter(text.lower()), None) is None:
        return []
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    out = {}
    for line in lines:
        if _weak(line) and (len(lines) == 1 or (not _ITEM.match(line) and len(_WORD.findall(line)) >= LEAST_WORDS)):
            out[_key(mask(line))] = None
    return [(m, "weak", False) for m in out]


def weak_titles(diff: str | None) -> list[tuple[str, str, bool]]:
    """As ``diff_messages``: the title, and what its separator parts, where it has a weak cue."""
    title = _title_of(diff) if diff else None
    if not title:
        return []
    return [(_key(mask(p)), "weak", False) for p in dict.fromkeys(_parts(title)) if _weak(_TECHNIQUE.sub(" ", p)) and len(_WORD.findall(p)) >= LEAST_WORDS]


def diff_messages(diff: str | None) -> list[tuple[str, str, bool]]:
    """Messages in the rendered title (the raw one if there is none) and in addresses that only rendering shows."""
    if not diff:
        return []
    try:
        j = json.loads(diff)
    except ValueError:
        return []
    if not isinstance(j, dict):
        return []
    out = title_messages(_title_of(diff))
    links = j.get("linksOnlyInRendered")
    for u in links if isinstance(links, list) else []:
        if isinstance(u, str) and BAD_ADDRESS.search(u):
            out.append((mask(BAD_ADDRESS.search(u).group(0)), "address", True))
            break
    return out


MESSAGES = "src string, row_id bigint, source string, message string, kind string, certain boolean"


def row_messages(body: str | None, is_diff: bool) -> list[tuple[str, str, bool]]:
    """All messages of a row; weak ones only where none is certain."""
    out = diff_messages(body) if is_diff else text_messages(body)
    if not any(certain for *_, certain in out):
        out = list(dict.fromkeys([*out, *(weak_titles(body) if is_diff else weak_lines(body))]))
    return out


def messages(units: DataFrame) -> DataFrame:
    """Flagged messages of ``src, row_id, source, body, is_diff``; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            src, ids, source, body, diff = (c.to_pylist() for c in b.columns)
            rows = [(i, *m) for i in range(b.num_rows) for m in row_messages(body[i], diff[i])]
            if rows:
                at = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([src[i] for i in at], pa.string()), pa.array([ids[i] for i in at], pa.int64()), pa.array([source[i] for i in at], pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.bool_())))],
                    names=["src", "row_id", "source", "message", "kind", "certain"],
                )

    return spread(units.select("src", "row_id", "source", "body", "is_diff")).mapInArrow(run, MESSAGES)


def units(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """The texts of existing pages and the render differences of crawl records as one input; both scans stay pruned."""
    p = pages.where(F.col("page_id").isNotNull() & F.col("text").isNotNull()).select(F.lit("existing_page").alias("src"), F.col("page_id").alias("row_id"), F.col("site").alias("source"), F.col("text").alias("body"), F.lit(False).alias("is_diff"))
    c = crawls.where(F.col("crawl_id").isNotNull() & F.col("render_diff").isNotNull()).select(F.lit("crawl_page").alias("src"), F.col("crawl_id").alias("row_id"), F.col("site").alias("source"), F.col("render_diff").alias("body"), F.lit(True).alias("is_diff"))
    return p.unionByName(c)


def recurring(found: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Each message with its rows and sources; ``widespread`` where it recurs in enough sources."""
    per_source = found.groupBy("message", "source").agg(F.max("kind").alias("kind"), F.max("certain").alias("certain"), F.count("*").alias("n"))
    return (
        per_source.groupBy("message")
        .agg(F.max("kind").alias("kind"), F.max("certain").alias("certain"), F.sum("n").alias("rows"), F.count("source").alias("sources"))
        .withColumn("widespread", F.col("sources") >= min_sources)
    )


def grouped(found: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """``src, row_id, settled, widespread``: of each row with a message, whether the words of one settle it, and whether one
    recurs in enough sources. All messages are grouped; few are widespread, so the join is on a short list."""
    wide = recurring(found, min_sources).where("widespread").select("message", F.lit(True).alias("wide")).distinct()
    met = found.select("src", "row_id", "message", "certain").join(wide, "message", "left")
    return met.groupBy("src", "row_id").agg(F.max("certain").alias("settled"), F.max(F.coalesce("wide", F.lit(False))).alias("widespread"))


def flagged(found: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """``src, row_id``: rows with a certain message, or another one that recurs widely."""
    return grouped(found, min_sources).where("settled or widespread").select("src", "row_id")


def shares(found: DataFrame) -> DataFrame:
    """Flagged rows by what decided: the words of a message, its recurrence over sources, or both."""
    return grouped(found).where("settled or widespread").groupBy("settled", "widespread").agg(F.count("*").alias("rows"))
