"""Problem 7: variant spellings of the names of organisations and persons.

Every name, variant and domain of a record is parsed into a core (the words that identify: family names, invented
words), a label (the trade of a firm or the given name of a person, nicknames resolved) and hints (legal form,
initials). Labels are learned (``learned_labels``): a word that stands beside very many other words names a kind of thing, not one
thing; the names of one record that differ in such words ("Insulation Works", "Insul. Wks"; "Elizabeth", "Liz") show which of
them mean the same, and those that carry legal forms are trades. A short general list of trades and given names serves what is too
rare to be learned. Records with equal parses are one class, so copies and versions cost nothing:

1. blocking: MinHash bands over the padded q-grams of the distinct cores; the number of bands follows from the wanted
   recall at the smallest similarity by the collision curve ``1 - (1 - s^r)^b``. One slip in a short word leaves fewer
   q-grams in common than any affordable number of bands finds, so cores also meet by the letters that their words keep
   after deletions, which misses no pair that the verification accepts (``near_terms``);
2. verification: symmetric Monge-Elkan similarity of the core words with Damerau distance inside;
3. labels: classes of one core family link only within one label. A class without a label takes the one that its hints
   and exclusions allow and that most records of its family carry;
4. star clustering: the class with most links takes its neighbours as satellites, round by round; stars that share a
   record are one entity.

Nothing is joined on records before clustering: buckets hold distinct spellings only, so an entity with a third of all
rows is as large as its number of spellings.

Defined cases: null and blank names are ignored; a record without any name is linked to nothing; abbreviations of up to
four capitals are shared by many and link nothing; several versions of one id count together.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.session import cut

#: q-grams; rows of a band; the similarity and recall that fix the number of bands.
Q, ROWS, LEAST_SIMILARITY, RECALL = 3, 3, 0.45, 0.98
#: Monge-Elkan similarity of two cores, and that of each of their words.
CORE_SIMILARITY, WORD_SIMILARITY = 0.8, 0.66
#: The least similarity of the best pair of words in an accepted pair of cores, by kind of term: words; words of longer
#: cores with initials (on both sides an initial can stand for the weaker words); the joined words of a core.
TERM_SIMILARITY = (CORE_SIMILARITY, 0.75, 0.85)
#: Deletion keys of a length from which terms meet by common bigrams instead.
MAX_KEYS = 3000

#: A label word stands beside at least this many different words, and beside this share of the distinct names; so no more
#: words than the inverse of the share, times the words of a name, can be label words, however large the table is.
LEAST_BESIDE, SHARE_BESIDE = 25, 0.001
#: The share of a label word's records that another must have to be its label, and the share of a label's records with a legal
#: form from which it is a trade.
SAME_LABEL, WITH_LEGAL = 0.2, 0.1

#: Common trades, for those too rare to be learned. The first word is the name of the trade.
TRADES = {
    "coffee": "coffee roasters roaster roastery coff cof kaffee kawa cafe", "sleep": "sleep studio std slp", "dental": "dental clinic dent dentist clin dentists", "pet": "pet pets supplies sup supply supp", "insulation": "insulation works insul wks ins",
    "logistics": "logistics log logist logistik haulage freight", "boatyard": "boatyard boat yd yard", "solar": "solar systems sys syst sol", "tiles": "international tiles intl tile", "tax": "tax advisers adv advisors adviser", "bicycle": "bicycle repair rep bike bikes cycle repairs", "bakery": "bakery bky bakers baker",
    "plumbing": "plumbing plumbers plumber heating", "law": "law lawyers solicitors attorneys legal kanzlei abogados", "garden": "garden gardens gardening nursery landscaping", "print": "print printing printers druckerei drukarnia", "travel": "travel tours reisen viajes", "media": "media publishing verlag", "software": "software technologies tech", "pharmacy": "pharmacy apotheke apteka farmacia", "hotel": "hotel hotels inn", "motors": "motors auto autos cars garage", "furniture": "furniture meble muebles", "optics": "optics optician opticians optik", "brewery": "brewery brewing brauerei browar", "security": "security alarms", "cleaning": "cleaning cleaners laundry", "construction": "construction builders building bau",
}
_TRADE_OF = {w: t for t, words in TRADES.items() for w in words.split()}
#: Common given names and their short forms, for those too rare to be learned.
GIVEN = {
    "dolores": "lola loli dolly lolita lol dolorcitas", "francisco": "paco curro pancho paquito frank", "wilhelm": "willi helm wim will willy", "william": "bill billy will willy liam", "katarzyna": "kasia kasienka kaska", "malgorzata": "gosia malgosia gosienka goska",
    "johannes": "hans jo johann hannes", "elizabeth": "beth betty liz lizzie eliza elizabeth lisa", "robert": "bob bobby rob robbie bert", "margaret": "meg peggy maggie marge madge greta", "henrietta": "etta hattie hetty henny", "theodore": "ted teddy theo", "stanislaw": "stach stas staszek stasiek stanislav", "aleksander": "olek alek aleks alex sasza olus",
    "ignacy": "ign ignas nacek ignac", "jozef": "jozek josef", "maria": "marysia mary", "alexander": "alex sandy alec xander", "katherine": "kate kathy katie kitty", "richard": "dick rick ricky", "james": "jim jimmy", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey sepp", "anna": "ania anka annie", "heinrich": "heinz heiner", "friedrich": "fritz", "henryk": "heniek",
    "thomas": "tom tommy", "michael": "mike mick mickey", "edward": "ed eddie ned", "charles": "charlie chuck", "samuel": "sam sammy", "daniel": "dan danny", "andrew": "andy drew", "anthony": "tony", "patricia": "pat patty tricia", "susan": "sue susie", "victoria": "vicky tori", "christopher": "chris kit", "antonio": "toni antonito", "manuel": "manolo", "rafael": "rafa", "magdalena": "magda lena", "agnieszka": "aga", "joanna": "asia", "tomasz": "tomek", "piotr": "piotrek", "andrzej": "andrzejek jedrek", "krzysztof": "krzysiek krzys", "ludwig": "lutz", "sebastian": "basti", "matthias": "matze", "ursula": "uschi ulla",
}
_GIVEN_OF: dict[str, frozenset[str]] = {}
for _name, _short in GIVEN.items():
    for _w in (_name, *_short.split()):
        _GIVEN_OF[_w] = _GIVEN_OF.get(_w, frozenset()) | {_name}

#: Legal forms by name.
_LEGAL = [
    ("zoo", r"\bsp(?:\.|olka)?\s*z\s*\.?\s*o\s*\.?\s*o\b\.?|\bspolka z o\.?\s?o\b\.?|\bsp\.?\s*zoo\b\.?"),
    ("gmbh", r"\bg\s?\.?\s?m\s?\.?\s?b\s?\.?\s?h\b\.?|\bmbh\b"),
    ("sa", r"\bsociedad anonima\b|\bs\s?\.\s?a\b\s?\.*|\bsa\b\.*\s*$"),
    ("ltd", r"\bltd\b\.?|\blimited\b"),
    ("inc", r"\binc\b\.?|\bincorporated\b"),
    ("other", r"\bllc\b|\bplc\b|\bag\b|\bs\.?\s?l\b\.?\s*$|\bco\b\.?\s*$"),
]
_LEGAL_RE = [(k, re.compile(p)) for k, p in _LEGAL]
_DOMAIN = re.compile(r"^(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)*)\.[a-z]{2,12}/?$")
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿąćęłńśźż])(?=[A-ZĄĆĘŁŃŚŹŻÄÖÜ][a-zà-ÿ])")
_ACRONYM = re.compile(r"^\W*(?:[A-Za-z]\W{0,2}){1,4}$")
_NOISE = frozenset("online the and und i y e of de la los las el group official team shop store www com example test invalid".split())


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace("ł", "l").replace("Ł", "L").replace("ß", "ss"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions)."""
    if a == b:
        return 0
    two: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, prev = prev, row
    return prev[-1]


def word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    return 0.0 if abs(len(a) - len(b)) > 3 else 1 - distance(a, b) / n


def _near(word: str, table: dict) -> str | None:
    """The entry of a fixed table that a word is, or is one slip away from if it is long."""
    if word in table:
        return word
    if len(word) < 6:
        return None
    return next((w for w in table if len(w) >= 6 and abs(len(w) - len(word)) <= 1 and distance(w, word) <= 1), None)


class Labels:
    """What label words mean: ``trades`` and ``given`` (each word with its possible labels), and words that say nothing."""

    def __init__(self, trades: dict[str, frozenset[str]] | None = None, given: dict[str, frozenset[str]] | None = None, noise: frozenset[str] = frozenset()) -> None:
        common = {w: frozenset((t,)) for w, t in _TRADE_OF.items()}
        self.trades, self.given, self.noise = {**common, **(trades or {})}, {**_GIVEN_OF, **(given or {})}, _NOISE | noise
        self.learned = (trades or {}, given or {})
        self.near: dict[str, tuple[str | None, str | None]] = {}

    def of(self, word: str) -> tuple[str | None, str | None]:
        """The words of the trades and of the given names that a word is, or is one slip away from; common words that the
        table doesn't show must be met exactly, for they may be next to anything."""
        if word not in self.near:
            if len(self.near) > 200_000:
                self.near.clear()
            self.near[word] = tuple(word if word in known else _near(word, own) for known, own in zip((self.trades, self.given), self.learned))
        return self.near[word]


COMMON = Labels()


def name_words(name: str | None) -> tuple[list[str], str, str] | None:
    """The words of a name without its legal form, their initials, and the legal form."""
    if not name or not name.strip():
        return None
    raw = unicodedata.normalize("NFKC", name).strip().strip("\"'«»“”„ ")
    if _ACRONYM.match(raw) and len(re.sub(r"\W", "", raw)) <= 4 and " " not in raw.strip():
        return None
    dom = _DOMAIN.match(fold(raw)) if " " not in raw else None
    s = dom.group(1).replace("-", " ").replace(".", " ") if dom else fold(_CAMEL.sub(" ", raw))
    legal = ""
    for key, p in _LEGAL_RE:
        if p.search(s):
            legal = key
            s = p.sub(" ", s)
    words, initials = [], ""
    for w in re.findall(r"[a-z0-9]+", s):
        if any(c.isdigit() for c in w):
            w = "".join({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t"}.get(c, c) for c in w)
        if len(w) == 1:
            initials += w
        else:
            words.append(w)
    return words, initials, legal


def parse(name: str | None, labels: Labels = COMMON) -> dict | None:
    """``core`` (identifying words in order of the alphabet), ``trade``, ``given`` (candidates), ``initials``, ``legal``."""
    read = name_words(name)
    if read is None:
        return None
    words, initials, legal = read
    core, trades, given = [], [], frozenset()
    for w in words:
        if w in labels.noise:
            continue
        t, g = labels.of(w)
        if t:
            trades += sorted(labels.trades[t])
        elif g and not given and not trades:
            given = labels.given[g]
        else:
            core.append(w)
    if not core:
        return None
    trade = max(set(trades), key=lambda t: (trades.count(t), t)) if trades else ""
    if trade or legal:
        if given:  # a firm whose family name is also a given name
            core.append(next(iter(sorted(given))))
        given, initials = frozenset(), ""
    return {"core": " ".join(sorted(core)), "trade": trade, "given": " ".join(sorted(given)), "initials": "".join(sorted(initials)), "legal": legal}


def _label_rows(df: DataFrame) -> DataFrame:
    """``id, name, word, legal`` of every distinct name and variant, one row for each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, variants = (c.to_pylist() for c in b.columns)
            out: list[tuple[str, int, str, bool]] = []
            for i, n, vs in zip(ids, names, variants):
                seen = set()
                for text in (n, *(vs or [])):
                    read = name_words(text)
                    if read and " " in (text or "").strip() and (key := tuple(sorted(set(read[0])))) not in seen:
                        seen.add(key)
                        h = xxhash.xxh3_64_intdigest(" ".join(key)) - (1 << 63)
                        out += [(i, h, w, bool(read[2])) for w in key]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["id", "name", "word", "legal"])

    return df.where(F.col("id").isNotNull()).select("id", "name", "variants").mapInArrow(run, "id string, name bigint, word string, legal boolean")


def learned_labels(df: DataFrame) -> Labels:
    """The label words of ``id, name, variants``. What reaches the driver is bounded by ``SHARE_BESIDE``, not by the table."""
    rows = cut(_label_rows(df), "words")
    spelled = rows.select("name", "word").distinct()
    a, b = spelled.alias("a"), spelled.alias("b")
    beside = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.word") != F.col("b.word"))).groupBy(F.col("a.word").alias("word")).agg(F.countDistinct("b.word").alias("n"))
    least = max(LEAST_BESIDE, int(SHARE_BESIDE * spelled.select("name").distinct().count()))
    words = cut(beside.where(F.col("n") >= least).select("word"), "labels")
    held = cut(rows.join(F.broadcast(words), "word").groupBy("id", "word").agg(F.max("legal").alias("legal")), "held")
    firm = held.groupBy("id").agg(F.max("legal").alias("legal"))
    count = {r["word"]: (r["n"], r["legal"]) for r in held.drop("legal").join(firm, "id").groupBy("word").agg(F.count("*").alias("n"), F.avg(F.col("legal").cast("int")).alias("legal")).collect()}
    x, y = held.alias("x"), held.alias("y")
    both = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.word") != F.col("y.word"))).groupBy(F.col("x.word").alias("a"), F.col("y.word").alias("b")).agg(F.count("*").alias("n"))
    share = both.join(held.groupBy(F.col("word").alias("a")).agg(F.count("*").alias("all")), "a").where(F.col("n") >= F.col("all") * SAME_LABEL).select("a", "b", "n").collect()
    beside_of: dict[str, dict[str, int]] = {}
    for r in share:
        beside_of.setdefault(r["a"], {})[r["b"]] = r["n"]
    rank = {w: (n, w) for w, (n, _) in count.items()}

    def heads(w: str) -> frozenset[str]:
        """The most frequent words that share enough of a word's records, each the head of its own."""
        out, todo, seen = set(), [w], {w}
        while todo:
            v = todo.pop()
            above = [u for u in beside_of.get(v, {}) if rank[u] > rank[v]]
            if not above:
                out.add(v)
            for u in above:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        return frozenset(out)

    trades: dict[str, frozenset[str]] = {}
    given: dict[str, frozenset[str]] = {}
    noise = set()
    for w, (n, legal) in count.items():
        top = heads(w)
        if not beside_of.get(w) and w not in {u for v in beside_of.values() for u in v} and w not in _TRADE_OF and w not in _GIVEN_OF:
            noise.add(w)  # beside everything, the same as nothing
        elif legal >= WITH_LEGAL:
            trades[w] = frozenset(_TRADE_OF.get(h, h) for h in top)
        else:
            given[w] = frozenset(x for h in top for x in _GIVEN_OF.get(h, (h,))) | _GIVEN_OF.get(w, frozenset())
    return Labels(trades, given, frozenset(noise))


def core_similarity(a: str, b: str, initials_a: str = "", initials_b: str = "") -> float:
    """Symmetric Monge-Elkan similarity of two cores; a word may also meet an initial of the other side."""
    x, y = a.split(), b.split()

    def one(p: list[str], q: list[str], initials: str) -> tuple[float, float]:
        best, full = [], 0.0
        for w in p:
            s = max((word_similarity(w, v) for v in q), default=0.0)
            full = max(full, s)
            if s < WORD_SIMILARITY:
                s = 0.85 if w[0] in initials else 0.0
            best.append(s)
        if any(s == 0.0 for s in best):
            return 0.0, full
        return sum(best) / len(best), full

    (s1, f1), (s2, f2) = one(x, y, initials_b), one(y, x, initials_a)
    joined = word_similarity("".join(x), "".join(y)) if len(x) != len(y) else 0.0
    if joined >= 0.85:
        return joined
    if min(f1, f2) < 0.75 or not (s1 and s2):
        return 0.0
    if len(x) == len(y) == 1 and not (initials_a or initials_b):
        return min(s1, s2) if min(len(a), len(b)) >= 5 else (1.0 if a == b else 0.0)
    return min(s1, s2)


def bands_for(similarity: float = LEAST_SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands from the collision curve: a pair of that similarity shares a bucket with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _grams(core: str) -> np.ndarray:
    out = {p[i : i + Q] for w in core.split() for p in (f"^{w}$",) for i in range(max(1, len(p) - Q + 1))}
    return np.fromiter((xxhash.xxh3_64_intdigest(g) for g in out), dtype=np.uint64, count=len(out))


_PARSED = "id string, core string, trade string, given string, initials string, legal string, main boolean, apart boolean"


def parsed_names(df: DataFrame, labels: Labels = COMMON) -> DataFrame:
    """One row for each distinct parsed name of ``id, name, variants, exclusions``; ``apart`` marks exclusions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, variants, apart = (c.to_pylist() for c in b.columns)
            rows = []
            for i, n, vs, xs in zip(ids, names, variants, apart):
                seen = set()
                for text, main, out in [(n, True, False), *((v, False, False) for v in vs or []), *((x, False, True) for x in xs or [])]:
                    p = parse(text, labels)
                    if p and (key := (*p.values(), out)) not in seen:
                        seen.add(key)
                        rows.append({"id": i, **p, "main": main, "apart": out})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), *((k, pa.string()) for k in ("core", "trade", "given", "initials", "legal")), ("main", pa.bool_()), ("apart", pa.bool_())]))

    return df.where(F.col("id").isNotNull()).select("id", "name", "variants", "exclusions").mapInArrow(run, _PARSED)


def term_keys(term: str, kind: int) -> set[str]:
    """Keys of which two terms have one in common if their similarity reaches that of the kind. Each of ``d`` slips takes
    at most one letter from the longer term, so all but ``d`` of its ``n`` letters stand in both in one order; of many
    letters, each slip takes at most three of the ``n + 1`` padded bigrams, and some are left."""
    out: set[str] = set()
    for n in range(len(term), len(term) + 4):  # the longer one's letters: words that differ by more are not similar
        keep = n - int((1 - TERM_SIMILARITY[kind]) * n + 1e-9)
        if keep > len(term):
            continue
        if math.comb(n, keep) <= MAX_KEYS:
            out.update(map("".join, combinations(term, keep)))
        else:
            padded = f"^{term}$"
            out.update(f"{n} {padded[i : i + 2]}" for i in range(len(padded) - 1))
    return out


def near_terms(terms: DataFrame) -> DataFrame:
    """``kind, term_a, term_b`` of all pairs (in both directions, and each with itself) of ``kind, term`` that are similar."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                at, keys = [], []
                for i, (kind, term) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    k = [xxhash.xxh3_64_intdigest(f"{kind} {x}") - (1 << 63) for x in term_keys(term, kind)]
                    at += [i] * len(k)
                    keys += k
                at_ = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at_), part.column(1).take(at_), pa.array(keys, pa.int64())], names=["kind", "term", "key"])

    @F.pandas_udf("double")
    def sim(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([word_similarity(x, y) for x, y in zip(a, b)])

    rows = cut(terms.mapInArrow(keyed, "kind int, term string, key bigint"), "terms")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.term") < F.col("b.term"))).select("a.kind", F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b")).distinct()
    near = cut(met.where(sim("term_a", "term_b") >= F.element_at(F.array(*(F.lit(x - 1e-9) for x in TERM_SIMILARITY)), F.col("kind") + 1)), "near")
    return near.unionAll(near.select("kind", F.col("term_b").alias("term_a"), F.col("term_a").alias("term_b"))).unionAll(terms.select("kind", F.col("term").alias("term_a"), F.col("term").alias("term_b")))


def pairs_by_terms(cores: DataFrame) -> DataFrame:
    """``core_a < core_b`` of ``core, initials``: all pairs that the verification can accept, by a similar word, or by
    similar joined words where the numbers of words differ."""
    words = F.split("core", " ")
    one = cores.groupBy("core").agg(F.max(F.col("initials") != "").alias("wide")).select("core", words.alias("words"), (F.col("wide") & (F.size(words) > 1)).alias("wide"))
    kinds = F.when(F.col("wide"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    by_word = one.select("core", F.size("words").alias("n"), kinds.alias("kinds"), F.explode(F.array_distinct("words")).alias("term")).withColumn("kind", F.explode("kinds")).drop("kinds")
    joined = one.select("core", F.size("words").alias("n"), F.array_join("words", "").alias("term"), F.lit(2).alias("kind"))
    at = cut(by_word.unionByName(joined), "core_terms")
    near = near_terms(at.select("kind", "term").distinct())
    a = at.select("kind", F.col("term").alias("term_a"), F.col("core").alias("core_a"), F.col("n").alias("n_a"))
    b = at.select("kind", F.col("term").alias("term_b"), F.col("core").alias("core_b"), F.col("n").alias("n_b"))
    met = near.join(a, ["kind", "term_a"]).join(b, ["kind", "term_b"])
    return met.where((F.col("core_a") < F.col("core_b")) & ((F.col("kind") < 2) | (F.col("n_a") != F.col("n_b")))).select("core_a", "core_b")


def core_pairs(cores: DataFrame) -> DataFrame:
    """Pairs ``core_a < core_b`` of ``core, initials`` that may be similar, by MinHash banding and by similar words."""
    bands = bands_for()
    rng = np.random.default_rng(7)
    m = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64)

    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores_, keys = [], []
            for core in b.column(0).to_pylist():
                h = _grams(core)[:, None] * m[None, :] + add[None, :]
                h ^= h >> np.uint64(33)
                h *= np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
                low = h.min(axis=0).reshape(bands, ROWS)
                key = low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + low[:, 2] * np.uint64(0x165667B19E3779F9)
                keys.append((key ^ (np.arange(bands, dtype=np.uint64) << np.uint64(50))).view(np.int64))
                cores_ += [core] * bands
            if keys:
                yield pa.RecordBatch.from_pydict({"core": pa.array(cores_, pa.string()), "band": pa.array(np.concatenate(keys))})

    rows = cut(cores.select("core").distinct().mapInArrow(band_rows, "core string, band bigint"), "bands")
    a, b = rows.alias("a"), rows.alias("b")
    cand = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.core") < F.col("b.core"))).select(F.col("a.core").alias("core_a"), F.col("b.core").alias("core_b"))
    return cand.unionAll(pairs_by_terms(cores)).distinct()


def similar(met: DataFrame) -> DataFrame:
    """``met`` (rows with ``core_a, initials_a, core_b, initials_b``) with ``sim``, where the verification accepts the two spellings.
    Every two different spellings are compared once, in one direction, however many nodes carry them; equal cores need no
    comparison."""

    @F.pandas_udf("double")
    def sim(a, ia, b, ib):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([core_similarity(w, x, y, z) for w, x, y, z in zip(a, b, ia, ib)])

    x, y = F.struct(F.col("core_a").alias("c"), F.col("initials_a").alias("i")), F.struct(F.col("core_b").alias("c"), F.col("initials_b").alias("i"))
    m = cut(met.withColumns({"p": F.least(x, y), "q": F.greatest(x, y)}), "met")
    d = m.where("core_a <> core_b").select("p", "q").distinct()
    told = d.withColumn("sim", sim("p.c", "p.i", "q.c", "q.i")).where(F.col("sim") >= CORE_SIMILARITY)
    other = m.where("core_a <> core_b").join(told, ["p", "q"])
    return other.unionByName(m.where("core_a = core_b").withColumn("sim", F.lit(1.0))).drop("p", "q")


def _compatible_given(a: str, b: str) -> F.Column:
    return F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) > 0


def linked(df: DataFrame) -> DataFrame:
    """``id, entity``: every record with a name, and the entity it stands for."""
    names = cut(parsed_names(df, learned_labels(df)), "names").distinct()
    own = names.where("not apart")
    # the label of a record: the trade or given name that most of its names carry
    lab = own.select("id", F.when(F.col("trade") != "", F.concat(F.lit("t:"), "trade")).when(F.col("given") != "", F.concat(F.lit("g:"), "given")).alias("label"), "main").where("label is not null")
    best = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("m"), "label")
    label = lab.groupBy("id", "label").agg(F.count("*").alias("n"), F.max("main").alias("m")).withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "label")
    facts = own.groupBy("id").agg(F.max("legal").alias("legal"))
    apart = names.where("apart and (trade <> '' or given <> '')").groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("trade") != "", F.concat(F.lit("t:"), "trade")).otherwise(F.concat(F.lit("g:"), "given")))).alias("apart"))
    rec = (
        own.select("id", "core", "initials").distinct().join(label, "id", "left").join(facts, "id").join(apart, "id", "left")
        .select("id", "core", "initials", F.coalesce("label", F.lit("")).alias("label"), "legal", F.coalesce("apart", F.array().cast("array<string>")).alias("apart"))
    )
    rec = cut(rec.withColumn("node", F.xxhash64("core", "initials", "label", "legal", "apart")), "records")
    nodes = cut(rec.groupBy("node", "core", "initials", "label", "legal", "apart").agg(F.count("*").alias("n")), "nodes")

    # similar cores, each with itself
    cand = core_pairs(nodes)
    both = cand.unionAll(cand.select(F.col("core_b").alias("core_a"), F.col("core_a").alias("core_b"))).unionAll(nodes.select(F.col("core").alias("core_a"), F.col("core").alias("core_b")).distinct())
    a = nodes.select(*(F.col(c).alias(f"{c}_a") for c in nodes.columns))
    b = nodes.select(*(F.col(c).alias(f"{c}_b") for c in nodes.columns))
    met = both.join(a, "core_a").join(b, "core_b").where(F.col("node_a") != F.col("node_b"))
    kind_ok = (
        ((F.substring("label_a", 1, 2) == F.substring("label_b", 1, 2)) | (F.col("label_a") == "") | (F.col("label_b") == ""))
        & ~((F.col("initials_a") != "") & F.col("label_b").startswith("t:"))
        & ~((F.col("initials_b") != "") & F.col("label_a").startswith("t:"))
    )
    same_trade = F.col("label_a") == F.col("label_b")
    same_given = F.col("label_a").startswith("g:") & F.col("label_b").startswith("g:") & _compatible_given(F.substring("label_a", 3, 200), F.substring("label_b", 3, 200))
    open_label = (F.col("label_a") == "") | (F.col("label_b") == "")
    not_apart = ~F.array_contains("apart_a", F.col("label_b")) & ~F.array_contains("apart_b", F.col("label_a"))
    initial_ok = (
        F.when((F.col("label_a") == "") & F.col("label_b").startswith("g:") & (F.col("initials_a") != ""), F.exists(F.split(F.substring("label_b", 3, 200), " "), lambda g: F.col("initials_a").contains(F.substring(g, 1, 1))))
        .when((F.col("label_b") == "") & F.col("label_a").startswith("g:") & (F.col("initials_b") != ""), F.exists(F.split(F.substring("label_a", 3, 200), " "), lambda g: F.col("initials_b").contains(F.substring(g, 1, 1))))
        .otherwise(F.lit(True))
    )
    edges = cut(similar(met.where(kind_ok & (same_trade | same_given | open_label) & not_apart & initial_ok).select("core_a", "initials_a", "core_b", "initials_b", "node_a", "node_b", "label_a", "label_b", "legal_a", "legal_b", "n_b")).drop("core_a", "initials_a", "core_b", "initials_b"), "links")

    # a node without a label takes the one its family carries
    votes = edges.where("label_a = '' and label_b <> ''").groupBy("node_a", "label_b").agg(F.max((F.col("legal_a") == F.col("legal_b")).cast("int")).alias("same"), F.max("sim").alias("sim"), F.sum("n_b").alias("n"))
    pick = Window.partitionBy("node_a").orderBy(F.desc("same"), F.desc(F.round("sim", 2)), F.desc("n"), "label_b")
    taken = votes.withColumn("r", F.row_number().over(pick)).where("r = 1").select(F.col("node_a").alias("node"), F.col("label_b").alias("taken"))
    final = cut(nodes.join(taken, "node", "left").select("node", "n", F.when(F.col("label") == "", F.coalesce("taken", F.lit(""))).otherwise(F.col("label")).alias("label")), "labels")
    fa, fb = final.select(F.col("node").alias("node_a"), F.col("label").alias("la")), final.select(F.col("node").alias("node_b"), F.col("label").alias("lb"))
    agree = (F.col("la") == F.col("lb")) | (F.col("la").startswith("g:") & F.col("lb").startswith("g:") & _compatible_given(F.substring("la", 3, 200), F.substring("lb", 3, 200)))
    links = cut(edges.select("node_a", "node_b").join(fa, "node_a").join(fb, "node_b").where(agree).select("node_a", "node_b").distinct(), "agreed")

    stars = star_clusters(final.select("node", "n"), links)
    # stars that share a record are one entity
    at = rec.select("id", "node").join(stars, "node").select("id", "star").distinct()
    hub = at.groupBy("id").agg(F.min("star").alias("hub"))
    merge = at.join(hub, "id").where("star <> hub").select(F.lit("").alias("src"), F.col("hub").alias("a"), F.col("star").alias("b")).distinct()
    comp = components(merge)
    return hub.join(comp.select(F.col("cid").alias("hub"), "comp"), "hub", "left").select("id", F.coalesce("comp", "hub").alias("entity"))


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, star``: each round every open node that outranks its open neighbours (by links, then records, then id)
    becomes a star and takes them. ``links`` holds both directions."""
    degree = links.groupBy("node_a").agg(F.count("*").alias("d")).withColumnRenamed("node_a", "node")
    rank = F.struct(F.coalesce("d", F.lit(0)).alias("d"), "n", "node")
    left = cut(nodes.join(degree, "node", "left").select("node", rank.alias("rank")), "open")
    done = left.select("node", F.col("node").alias("star")).limit(0)
    while True:  # each round closes the open node that outranks all others, at least
        n = left.count()
        if not n:
            return done
        o = left.select(F.col("node").alias("node_b"), F.col("rank").alias("rank_b"))
        live = links.join(left.select(F.col("node").alias("node_a"), "rank"), "node_a").join(o, "node_b")
        top = live.groupBy("node_a").agg(F.max("rank_b").alias("top"))
        hubs = left.join(top, left["node"] == top["node_a"], "left").where(F.col("top").isNull() | (F.col("rank") > F.col("top"))).select("node", "rank")
        hubs = cut(hubs, "hubs")
        sats = (
            links.join(hubs.select(F.col("node").alias("node_a"), "rank"), "node_a").join(left.select(F.col("node").alias("node_b")), "node_b")
            .groupBy(F.col("node_b").alias("node")).agg(F.max("rank").alias("rank")).select("node", F.col("rank.node").alias("star"))
        )
        new = cut(sats.unionByName(hubs.select("node", F.col("node").alias("star"))), "stars")
        done = done.unionByName(new)
        left = cut(left.join(new, "node", "left_anti"), "open")


def found(df: DataFrame) -> DataFrame:
    """All pairs of different ids of one entity."""
    e = cut(linked(df), "entities")
    a, b = e.select(F.col("id").alias("id_a"), "entity"), e.select(F.col("id").alias("id_b"), "entity")
    return a.join(b, "entity").where("id_a < id_b").select("id_a", "id_b")
