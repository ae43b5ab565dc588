"""Problem 4: the main body of pages, without navigation, notices, sidebars and footers.

Site style tree. The pages of one host are merged into one tree. Each line of a page is an element. Its presentation
(list of separated items, labelled line, running text, bullet, short line) and, for short lines, its place on the page
(above, between or below the running text) choose the branch; its contents are the features below that branch: the items of
a list, the label of a labelled line, the sentences of running text, each with numbers masked, and the text of a short line.

A feature that occurs ``c_j`` times on page ``j`` of a host with ``m`` pages has the entropy
``H = - sum p_j log_m p_j`` over its pages (``p_j = c_j / K``, ``K`` the sum), less that of one occurrence, which is no
recurrence, so that small hosts need no limit of their own. The importance of a line is ``1`` less the mean entropy of its
features: 0 for what all pages say in the same place, 1 for what only one page says. Labels are also merged over the hosts:
the label of a slot that a page template fills with other links each time is spread evenly over many hosts, that of
a heading only over those of one subject, so the mean of both levels has a limit of its own. Branches of an importance at or
below the limit of their presentation (``LIMITS``) are removed from each page.

What a line says is a prior: a line whose wording or presentation alone marks furniture (``style_rule``: consent, copyright,
sharing, labels of related links) is removed at any importance. ``furniture`` tells which of both decided.

Every line leaves the first pass as hashes; texts are never shuffled. The counts are combinable sums for each feature, so a
host with a third of all pages is one more key. Only features that recur are joined back, each line keeps its few.

Defined cases: null, empty and blank texts have no lines; JSON that doesn't parse gives nothing; blank lines count in
the numbering but are never reported; rows are distinct; a null site is a host of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, spread

#: The largest importance of a line that is removed, by presentation: list, label, running text, short line before, after
#: and between running text, bullet. Between running text, headings and items of a subject recur as often as furniture does:
#: there only what stands on nearly all pages goes.
LIST, LABEL, RUN, HEAD, TAIL, INNER, ITEM = range(7)
LIMITS = {LIST: 0.65, LABEL: 0.45, RUN: 0.45, HEAD: 0.3, TAIL: 0.42, INNER: 0.02, ITEM: 0.02}
#: The same of a label whose entropy is the mean of that over its host's pages and that over the hosts.
SLOT = 0.58
#: A short text that stands so many times as often behind the running text as between is furniture there, too.
MOSTLY_BEHIND = 1.5

BULLET = re.compile(r"^\s*(?:[-*•–·▪◦]|\d{1,2}[.)])\s+")
_SEPARATORS = (" | ", " › ", " » ", " > ", " / ", " · ", " • ", " - ", " – ", " — ", " :: ", "\t", "   ", "  ", " ~ ", ", ")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")

#: Items of site menus.
NAV = frozenset(
    "home|start|shop|store|stores|blog|news|help|contact|contact us|prices|pricing|guides|about|about us|basket|cart|log in|login|sign in|sign up|register|my account|account|search|menu|faq|support|services|products|categories|wishlist|checkout|team|jobs|careers|press|sitemap|accessibility|imprint|terms|terms of use|privacy|privacy policy|legal notice|skip to content|back to top"
    "|strona główna|sklep|aktualności|pomoc|kontakt|cennik|poradniki|o nas|koszyk|zaloguj się|zaloguj|logowanie|zarejestruj się|moje konto|konto|szukaj|usługi|produkty|kategorie|kariera|praca|dla prasy|mapa strony|dostępność|regulamin|polityka prywatności|do góry"
    "|startseite|laden|geschäfte|filialen|neuigkeiten|neues|aktuelles|hilfe|preise|ratgeber|über uns|warenkorb|anmelden|einloggen|registrieren|mein konto|konto|suche|leistungen|produkte|kategorien|karriere|presse|impressum|datenschutz|agb|barrierefreiheit|nach oben"
    "|inicio|tienda|tiendas|noticias|ayuda|contacto|precios|guías|quiénes somos|sobre nosotros|cesta|carrito|entrar|iniciar sesión|acceder|registrarse|mi cuenta|cuenta|buscar|servicios|productos|categorías|empleo|prensa|mapa del sitio|accesibilidad|condiciones|privacidad|aviso legal|volver arriba".split("|")
)

_COOKIE = re.compile(
    r"\b(?:we|this site|our site|our partners and we) (?:and our partners )?uses? (?:\w+ )?cookies|\bcookies help (?:us|\w+)|\bthis (?:site|website|page) (?:stores|uses|keeps) (?:small files|cookies)|\byour privacy matters|\bwe (?:value|respect|care about) your privacy|cookie (?:settings|policy|notice|preferences|consent)"
    r"|używamy (?:plików cookie|ciasteczek)|(?:strona|witryna|serwis) (?:używa|korzysta z|zapisuje) (?:plików cookie|ciastecz\w+|małe pliki)|ciasteczka pomagają|\bdba o (?:twoją|państwa) prywatność|szanujemy twoją prywatność|ustawienia (?:plików )?cookie|polityka cookie"
    r"|wir (?:verwenden|nutzen|setzen) (?:\w+ )?cookies|cookies helfen|(?:seite|website) (?:speichert|verwendet|nutzt) (?:kleine dateien|cookies)|achtet auf ihre privatsphäre|ihre privatsphäre ist|cookie-einstellungen|cookie-richtlinie"
    r"|usamos cookies|utilizamos cookies|las cookies (?:nos )?ayudan|(?:sitio|página|web) (?:guarda|usa|utiliza) (?:pequeños archivos|cookies)|cuida su privacidad|su privacidad (?:nos )?importa|configuración de cookies|política de cookies",
    re.I,
)
_CONSENT = re.compile(
    r"accept all|reject all|accept cookies|ok, got it|change your choice (?:at any time )?in settings|by staying here you agree|akceptuję|odrzucam|pozostając tutaj, wyrażasz zgodę|wybór można zmienić w ustawieniach|alle annehmen|alle akzeptieren|auswahl lässt sich jederzeit ändern|mit dem verbleib stimmen sie zu|aceptar todo|rechazar todo|si sigue aquí, acepta|puede cambiar su elección",
    re.I,
)
_SHARE_LINE = re.compile(
    r"^(?:share|share this(?: page| article| post)?|share on|follow us|udostępnij|podziel się|obserwuj nas|teilen|seite teilen|folgen sie uns|folge uns|compartir|comparta|compártelo|síganos|síguenos)\s*(?:[|:·•/›»>\t-]|\s{2,}|$)",
    re.I,
)
_LETTER = re.compile(
    r"newsletter|\bboletín\b|subscribe (?:for|to|now)|weekly tips|leave your address and we|sign up for (?:our|weekly|the)|zapisz się na|cotygodniowe porady|zostaw adres|wöchentliche tipps|adresse hinterlassen|jetzt abonnieren|rundbrief|suscríb[ae]se|consejos semanales|deje su dirección",
    re.I,
)
_FOOTER = re.compile(
    r"^\W{0,3}(?:©|\(c\)|copyright\b)|all rights reserved|wszelkie prawa zastrzeżone|alle rechte vorbehalten|todos los derechos reservados|^made with (?:care|love|♥)|^(?:stworzone|zrobione) z |^mit (?:sorgfalt|liebe) gemacht|^hecho con |^powered by"
    r"|^(?:office|opening|business) hours\b|^biuro czynne|^godziny otwarcia|^büro (?:mo|öffnungs)|^öffnungszeiten|^oficina lun|^horario(?: de)? ",
    re.I,
)
#: Calls to leave an address.
_CALL = re.compile(r"^(?:join|subscribe|sign up|leave|get|receive|enter|dołącz|zapisz|zostaw|odbieraj|podaj|jetzt|abonnieren|melden|hinterlassen|erhalten|adresse|suscr[ií]b|únete|únase|deje|recib|introduzca)", re.I)
_SIDE_LABELS = (
    "related|related posts|related articles|related pages|read also|read more|read next|see also|you might also like|you may also like|most read|most popular|popular this week|popular now|popular|trending|recent posts|latest posts|previous post|next post|previous|next|tag|tags|categories|filed under|more from|more on this"
    "|powiązane|podobne|zobacz też|zobacz także|czytaj też|czytaj także|przeczytaj też|przeczytaj także|może cię zainteresować|najczęściej czytane|popularne w tym tygodniu|popularne|ostatnie wpisy|poprzedni wpis|następny wpis|tagi|kategorie|więcej na ten temat"
    "|ähnlich|ähnliche beiträge|ähnliche artikel|siehe auch|lesen sie auch|auch lesenswert|mehr dazu|das könnte sie interessieren|das könnte sie auch interessieren|das könnte ihnen gefallen|das könnte ihnen auch gefallen|vielleicht gefällt ihnen|meistgelesen|am meisten gelesen|beliebt in dieser woche|beliebt diese woche|beliebt|neueste beiträge|voriger beitrag|vorheriger beitrag|nächster beitrag|schlagwörter|schlagworte|kategorien"
    "|relacionado|relacionados|artículos relacionados|lea también|lea además|ver también|véase también|le puede gustar|le puede interesar|también le puede gustar|lo más leído|más leído|más leídos|popular esta semana|populares|entradas recientes|entrada anterior|entrada siguiente|siguiente entrada|etiquetas|categorías"
).split("|")
_SIDE = re.compile("^(?:" + "|".join(re.escape(x) for x in sorted(_SIDE_LABELS, key=len, reverse=True)) + r")\b\s*(?P<mark>[:»›>|–—-]*)", re.I)
#: Sidebar labels that need no mark behind them; the others do.
_SIDE_FREE = re.compile(r"^(?:you (?:might|may) also like|może cię zainteresować|das könnte|vielleicht gefällt|le puede|también le puede)", re.I)


#: Words without which no unanchored rule can apply.
_CUES = ahocorasick.Automaton()
for _w in (
    "cookie", "ciasteczk", "small files", "małe pliki", "kleine dateien", "pequeños archivos", "privacy", "prywatność", "privatsphäre", "privacidad", "accept all", "reject all", "got it", "your choice", "agree",
    "akceptuję", "odrzucam", "zgodę", "ustawieniach", "annehmen", "akzeptieren", "ändern", "verbleib", "aceptar", "rechazar", "acepta", "elección", "newsletter", "boletín", "subscribe", "weekly tips", "leave your address", "sign up", "zapisz się",
    "cotygodniowe", "zostaw adres", "wöchentliche", "hinterlassen", "abonnieren", "rundbrief", "suscríb", "consejos", "dirección", "©", "(c)", "copyright", "reserved", "zastrzeżone", "vorbehalten", "reservados", "made with", "stworzone z",
    "zrobione z", "gemacht", "hecho con", "powered by", "hours", "biuro czynne", "godziny", "büro", "öffnungszeiten", "oficina", "horario",
):
    _CUES.add_word(_w, 1)
_CUES.make_automaton()


def host_of(site: str | None) -> str:
    s = (site or "").strip().lower()
    for p in ("sc-domain:", "https://", "http://"):
        s = s.removeprefix(p)
    return s.split("/", 1)[0]


def plain(line: str) -> str:
    return _SPACE.sub(" ", line).strip()


def items_of(line: str) -> tuple[str, list[str]]:
    """The separator that cuts the line into most items, and the items."""
    best: tuple[str, list[str]] = ("", [plain(line)])
    s = line.strip().replace("\xa0", " ")
    for sep in _SEPARATORS:
        if sep in s:
            parts = [p.strip() for p in s.split(sep)]
            parts = [p for p in parts if p]
            if len(parts) > len(best[1]):
                best = (sep, parts)
    return best


def is_sentence(line: str) -> bool:
    """Whether a line is running text, whose separators part no items."""
    return len(line) > 60 and line.rstrip("«»\"'“”„ ")[-1:] in (".", "!", "?")


def _mostly(s: str, *patterns: re.Pattern) -> bool:
    """Whether at least each third sentence of a line fits one of the patterns."""
    parts = s.split(". ")
    return 3 * sum(any(p.search(x) for p in patterns) for x in parts) >= len(parts)


def style_rule(line: str) -> bool | None:
    """True: furniture by its wording and presentation; None: the tree decides."""
    s = plain(line)
    if BULLET.match(line):
        return None
    bare = s.strip("«»\"'“”„ ")
    running = is_sentence(s)
    if next(_CUES.iter(s.lower()), None) is not None:
        if _mostly(s, _CONSENT, _COOKIE) or _mostly(bare, _FOOTER):
            return True
        if _LETTER.search(bare) and ". " not in bare and not (running and not _CALL.match(bare)):
            return True
    if not running and _SHARE_LINE.match(bare):
        return True
    m = _SIDE.match(bare)
    if m and (m.group("mark") or _SIDE_FREE.match(bare)) and len(_SENTENCE.split(bare[m.end() :].strip())) == 1:
        return True
    if bare.lower() in NAV:
        return True
    if running:
        return None
    sep, items = items_of(line)
    if len(items) >= 2:
        low = [x.lower().strip(" .:|›»>/·•-–—") for x in items]
        known = sum(x in NAV for x in low)
        if known >= 2 and known >= 0.6 * len(items):
            return True
        if known and low[0] in NAV and sep.strip() in (">", "›", "»", "/", "|", "·", "•", "-", "–", "::") and len(items) <= 6:
            return True
    return None


# --- the tree ------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_LIST_MARK = re.compile(r"\s(?:[|›»>/·•~–—-]|::)\s|\s*[|›»·•]\s*|\t+|\s{2,}")
_LABEL_MARK = re.compile(r"\s*[:»›|]\s+(?=\S)")
_LABEL_WORDS = 6


def folded(s: str, masked: bool = True) -> str:
    low = plain(s).lower().strip(" .:|›»>/·•-–—\"'“”„«»")
    return _NUMBER.sub("0", low) if masked else low


def presented(line: str) -> tuple[str, list[str], str | None]:
    """The presentation of a line (``list``, ``run``, ``item`` or ``short``), its features, and its label if it has one."""
    s = line.strip().replace("\xa0", " ")
    if BULLET.match(line):
        return "item", [folded(BULLET.sub("", line, count=1))], None
    sentences = _SENTENCE.split(plain(line))
    m = _LABEL_MARK.search(s) if len(sentences) == 1 else None
    label = folded(s[: m.start()]) if m and s[:1].isalpha() and len(s[: m.start()].split()) <= _LABEL_WORDS else None
    if not is_sentence(plain(line)):
        items = [x for x in map(folded, _LIST_MARK.split(s)) if x]
        if len(items) >= 2:
            return "list", items, label
        if len(sentences) == 1:
            return "short", [folded(line, masked=False)], label  # titles that differ in a number are different titles
    return "run", [x for x in map(folded, sentences) if x] or [folded(line)], label


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts))


#: Where a short line stands: before, between or after the running text.
_PLACES = ("head", "inner", "tail")


def hashed(line: str) -> tuple[str, list[int], list[int], int | None, bool]:
    """Of a line: presentation, the hashes of its features (of a short line in each place, and as an item of a list) and how
    often each occurs in it, its label, and whether its wording decides."""
    kind, features, label = presented(line)
    if kind == "short":
        hashes = [*(_hash(x, features[0]) for x in _PLACES), _hash("list", features[0])]
        counts = [1]
    else:
        unique = list(dict.fromkeys(features))
        hashes, counts = [_hash(kind, x) for x in unique], [features.count(x) for x in unique]
    return kind, hashes, counts, None if label is None else _hash("label", label), bool(style_rule(line))


def page_lines(text: str | None) -> Iterator[tuple[int, str]]:
    if text:
        for i, line in enumerate(text.split("\n")):
            if line and not line.isspace():
                yield i, line


def facts_text(facts: str | None) -> str | None:
    if not facts:
        return None
    try:
        j = json.loads(facts)
    except ValueError:
        return None
    t = j.get("text") if isinstance(j, dict) else None
    return t if isinstance(t, str) else None


_LINES = "src string, row_id bigint, host bigint, page int, line_no int, kind int, weight double, sure boolean, node bigint, role int, c int, label bigint"
_CACHE = 200_000
#: What a node is to its line: a feature, the label, or (not counted for the line) the text as an item of a list, or as a
#: short line behind the running text.
FEATURE, AS_LABEL, AS_ITEM, AS_TAIL = range(4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def page_nodes(text: str | None, known: dict) -> tuple[list[tuple], bool]:
    """Rows ``(line_no, kind, weight, sure, feature, role, count, label)`` of a page, and whether it has lines. ``count`` is how
    often the page holds the feature, at its first place; 0 at the others."""
    lines = []
    for no, line in page_lines(text):
        h = known.get(line)
        if h is None:
            if len(known) >= _CACHE:
                known.clear()
            known[line] = h = hashed(line)
        lines.append((no, *h))
    text_at = [i for i, x in enumerate(lines) if x[1] == "run"]
    first, last = (text_at[0], text_at[-1]) if text_at else (len(lines), len(lines))
    rows = []
    total: dict[int, int] = {}
    for i, (no, kind, features, counts, label, sure) in enumerate(lines):
        if kind == "short":
            place = 0 if i < first else 2 if i > last else 1
            rows.append((no, (HEAD, INNER, TAIL)[place], 1.0, sure, features[place], FEATURE, 1, None))
            total[features[place]] = total.get(features[place], 0) + 1
            if place == 0:
                rows.append((no, HEAD, 1.0, sure, features[3], AS_ITEM, 0, None))
            elif place == 1:
                rows.append((no, INNER, 1.0, sure, features[2], AS_TAIL, 0, None))
        else:
            code, n = {"list": LIST, "run": RUN, "item": ITEM}[kind], sum(counts)
            for f, c in zip(features, counts):
                rows.append((no, code, c / n, sure, f, FEATURE, 1, None))
                total[f] = total.get(f, 0) + c
        if label is not None:
            rows.append((no, rows[-1][1], 1.0, sure, label, AS_LABEL, 1, label))
            total[label] = total.get(label, 0) + 1
    return [(*r[:6], total.pop(r[4], 0) if r[6] else 0, r[7]) for r in rows], bool(lines)


def tree_rows(units: DataFrame) -> DataFrame:
    """The features of all lines of ``src, row_id, source, body, is_facts`` as nodes of their host's tree; one row with a
    null ``line_no`` for each page that has lines, for counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in chunks(batches):
            _, _, source, body, facts = (c.to_pylist() for c in b.columns)
            at, hosts, pages, rows = [], [], [], []
            for i in range(b.num_rows):
                text = facts_text(body[i]) if facts[i] else body[i]
                own, some = page_nodes(text, known)
                if some:
                    own.append((None, 0, 0.0, False, 0, 0, 0, None))
                    at += [i] * len(own)
                    hosts += [_hash("host", host_of(source[i])) >> 1] * len(own)
                    pages += [(_hash(text) >> 32) - (1 << 31)] * len(own)  # tells copies of a page apart from other pages of its host
                    rows += own
            if not rows:
                continue
            no, kind, weight, sure, feature, role, c, label = zip(*rows)
            host = np.array(hosts, dtype=np.uint64)
            node = (np.array(feature, dtype=np.uint64) ^ (host * _MIX)).view(np.int64)
            where = pa.array(at)
            signed = pa.array([None if x is None else x - (1 << 63) for x in label], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(where), b.column(1).take(where), pa.array(host.view(np.int64)), pa.array(pages, pa.int32()), pa.array(no, pa.int32()), pa.array(kind, pa.int32()), pa.array(weight, pa.float64()), pa.array(sure), pa.array(node), pa.array(role, pa.int32()), pa.array(c, pa.int32()), signed],
                names=["src", "row_id", "host", "page", "line_no", "kind", "weight", "sure", "node", "role", "c", "label"],
            )

    return spread(units.select("src", "row_id", "source", "body", "is_facts")).mapInArrow(run, _LINES)


def units(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """Texts of existing pages and facts of crawl records as one input; the scans read only these columns."""
    p = pages.where(F.col("page_id").isNotNull() & F.col("text").isNotNull()).select(F.lit("existing_page").alias("src"), F.col("page_id").alias("row_id"), F.col("site").alias("source"), F.col("text").alias("body"), F.lit(False).alias("is_facts"))
    c = crawls.where(F.col("crawl_id").isNotNull() & F.col("facts").isNotNull()).select(F.lit("crawl_page").alias("src"), F.col("crawl_id").alias("row_id"), F.col("site").alias("source"), F.col("facts").alias("body"), F.lit(True).alias("is_facts"))
    return p.unionByName(c)


def node_entropy(rows: DataFrame) -> DataFrame:
    """``node, entropy, both, k``: how evenly each feature that recurs is spread over the pages of its host, from 0 to 1; for
    labels the mean of that and of how evenly the label is spread over the hosts; and how often it occurs."""
    pages = rows.where("line_no is null").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("m"))
    # pages of equal text are one page: a page that is copied many times must not make its own lines furniture
    once = rows.where("line_no is not null and c > 0").groupBy("node", "page").agg(F.max("host").alias("host"), F.max("label").alias("label"), F.max("c").alias("c"))
    stat = once.groupBy("node").agg(F.max("host").alias("host"), F.max("label").alias("label"), F.sum("c").alias("k"), F.sum(F.when(F.col("c") > 1, F.col("c") * F.log("c")).otherwise(0.0)).alias("s"))
    stat = stat.where("k > 1 or label is not null")
    recurs = stat.where("k > 2").join(pages, "host")
    own = F.when(F.col("m") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log(F.col("k") - 1) - F.col("s") / F.col("k")) / F.log("m")))).otherwise(0.0)
    hosts = pages.agg(F.count("*").alias("hosts"))  # one row
    labels = stat.where("label is not null").groupBy("label").agg(F.sum("k").alias("lk"), F.sum(F.col("k") * F.log("k")).alias("ls"))
    over_hosts = F.when(F.col("hosts") > 1, (F.log("lk") - F.col("ls") / F.col("lk")) / F.log("hosts"))
    spread_of = labels.crossJoin(F.broadcast(hosts)).select("label", over_hosts.alias("over"))
    plain_nodes = recurs.where("label is null").select("node", own.alias("entropy"), F.lit(0.0).alias("both"), "k")
    label_nodes = recurs.join(spread_of, "label").select("node", own.alias("entropy"), ((own + F.coalesce("over", own)) / 2).alias("both"), "k")
    return plain_nodes.unionByName(label_nodes)


def importance(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``src, row_id, line_no, kind, sure, importance, label, slot``: the importance in the tree of ``rows`` of each of ``lines``
    that has a recurring feature or a wording that decides, and those of its label on its host and over all hosts, 1 without
    one."""
    lines = lines.where("line_no is not null").select("src", "row_id", "line_no", "kind", "weight", "sure", "node", "role")
    met = lines.join(node_entropy(rows), "node", "left").where("sure or entropy is not null")
    h = F.coalesce("entropy", F.lit(0.0))
    # rows may be repeated: a line's features are a set, as many as the line is long
    of_line = met.groupBy("src", "row_id", "line_no", "kind", "sure").agg(F.collect_set(F.struct("role", "node", (F.col("weight") * h).alias("h"), F.coalesce("both", F.lit(0.0)).alias("both"), F.coalesce("k", F.lit(0)).alias("k"))).alias("x"))

    def most(role: int, value: str) -> F.Column:
        return F.coalesce(F.array_max(F.transform(F.filter("x", lambda e: e["role"] == role), lambda e: e[value])), F.lit(0))

    own = F.aggregate(F.filter("x", lambda e: e["role"] == FEATURE), F.lit(0.0), lambda acc, e: acc + e["h"])
    of_line = of_line.select("src", "row_id", "line_no", "kind", "sure", own.alias("own"), most(AS_LABEL, "h").alias("label"), most(AS_LABEL, "both").alias("both"), F.greatest(most(AS_ITEM, "h"), most(AS_TAIL, "h")).alias("other"), most(FEATURE, "k").alias("k"), most(AS_TAIL, "k").alias("behind"))
    belongs = (F.col("kind") == INNER) & (F.col("behind") > 0) & (F.col("behind") >= MOSTLY_BEHIND * F.col("k"))
    kind = F.when(belongs, F.lit(TAIL)).otherwise(F.col("kind"))
    entropy = F.when((F.col("kind") == HEAD) | belongs, F.greatest("own", "other")).otherwise(F.col("own"))
    return of_line.select("src", "row_id", "line_no", kind.alias("kind"), "sure", (1 - entropy).alias("importance"), (1 - F.col("label")).alias("label"), (1 - F.col("both")).alias("slot"))


def judged(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``src, row_id, line_no, by_tree, by_wording`` of the lines (of ``lines``, or all) that are not main body."""
    limit = F.element_at(F.array(*(F.lit(LIMITS[k]) for k in range(len(LIMITS)))), F.col("kind") + 1)
    tree = (F.col("importance") <= limit) | (F.col("label") <= LIMITS[LABEL]) | (F.col("slot") <= SLOT)
    found = importance(rows, rows if lines is None else lines).select("src", "row_id", "line_no", tree.alias("by_tree"), F.col("sure").alias("by_wording"))
    return found.where("by_tree or by_wording").groupBy("src", "row_id", "line_no").agg(F.max("by_tree").alias("by_tree"), F.max("by_wording").alias("by_wording"))


def furniture(rows: DataFrame) -> DataFrame:
    """``src, row_id, line_no`` of the lines that are not main body. ``rows`` is read several times: pass a written table.
    Lines that their wording settles need no look at the tree, which they are part of all the same."""
    worded = rows.where("sure").select("src", "row_id", "line_no").distinct()
    return worded.unionByName(judged(rows, rows.where("not sure")).select("src", "row_id", "line_no"))


def shares(rows: DataFrame) -> DataFrame:
    """Lines that are not main body, by what decided them: the tree, its wording, or both."""
    return judged(rows).groupBy("by_tree", "by_wording").agg(F.count("*").alias("lines"))


def main_text(units_df: DataFrame, removed: DataFrame) -> DataFrame:
    """``src, row_id, body``: the text without the removed lines, null where a page has no text."""
    text_of = F.pandas_udf(lambda s: s.map(facts_text), "string")
    texts = units_df.select("src", "row_id", F.when(F.col("is_facts"), text_of("body")).otherwise(F.col("body")).alias("text")).groupBy("src", "row_id").agg(F.min("text").alias("text"))
    gone = removed.groupBy("src", "row_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return texts.join(gone, ["src", "row_id"], "left").select("src", "row_id", F.array_join(kept, "\n").alias("body"))
