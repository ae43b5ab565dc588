"""Furniture of sites in wordings and languages that no list of the library holds."""

import random

from brindle.llm import boilerplate

#: By site: menu items, crumbs, labels of links that change, and fixed lines.
SITES = {
    "fr": (["Accueil", "Boutique", "Livraison", "Nous écrire", "Panier"], "Accueil › Cuisine", ["À lire aussi", "Dans la même rubrique"], ["Ce site dépose des témoins de connexion sur votre appareil. Continuer vaut accord.", "Tous droits réservés, maison Perrin", "Partagez ce billet", "Recevez notre lettre du mardi", "Magasin ouvert du lundi au vendredi"]),
    "it": (["Pagina iniziale", "Negozio", "Chi siamo", "Carrello", "Spedizioni"], "Pagina iniziale › Attrezzi", ["Potrebbe piacerti", "Articolo seguente"], ["Questo sito conserva piccoli file sul tuo dispositivo. Restando qui accetti le nostre regole.", "Tutti i diritti riservati, bottega Rossi", "Condividi questo articolo", "Iscriviti alla nostra lettera", "Aperti dal lunedì al venerdì"]),
    "nl": (["Beginpagina", "Winkel", "Over ons bedrijf", "Winkelmand", "Bezorging"], "Beginpagina › Gereedschap", ["Ook interessant", "Volgend bericht"], ["Wij bewaren kleine bestanden op uw toestel. Wie verder leest, gaat daarmee akkoord.", "Alle rechten voorbehouden, huis De Wit", "Deel dit bericht", "Schrijf u in voor onze nieuwsbrief", "Geopend van maandag tot vrijdag"]),
    "en": (["Front desk", "Catalogue", "Who runs this", "Your bag", "Delivery desk"], "Front desk › Tools", ["From the same shelf", "Readers then opened"], ["This place keeps a few crumbs of data on your device. Reading on means that you are fine with it.", "Every right stays with the Miller family", "Pass this page on", "Letters from our yard each Tuesday", "The yard opens from Monday to Friday"]),
}
NOUNS = "table lamp rope anchor window kettle pillow saddle brush engine panel ledger basket hammer mirror carpet bottle ladder candle wheel drawer blanket".split()
VERBS = "carries holds outlasts replaces protects covers needs follows supports hides".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of {rng.choice(NOUNS)}s {rng.choice(VERBS)} the {rng.choice(NOUNS)} number {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} of {rng.choice(NOUNS)}s."


def title(rng):
    return f"How a {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} by the {rng.choice(NOUNS)}"


def sites(pages):
    rng = random.Random(11)
    rows, want, total = [], set(), 0
    for s, (menu, crumb, labels, fixed) in enumerate(SITES.values()):
        for i in range(pages):
            items = rng.sample(menu, 4)
            lines = [(" | ".join(items), True)] if i % 2 else [(x, True) for x in items]
            lines += [(f"{crumb} › {title(rng)}", True), (title(rng), False), (sentence(rng) + " " + sentence(rng), False)]
            lines += [(rng.choice(["Sizes", "Before you start", "What we saw"]), False), (sentence(rng), False)]
            if i % 3 == 0:
                lines += [(f"- {rng.choice(NOUNS)}", False), (f"- {rng.choice(NOUNS)}", False)]
            if i % 2:
                lines.append((f"{rng.choice(labels)}: {title(rng)}", True))
            lines += [(sentence(rng), False)]
            lines += [(x, True) for x in rng.sample(fixed, 4)]
            row = 1000 * s + i
            rows.append((row, f"https://site{s}.example/", "\n".join(x for x, _ in lines)))
            want |= {(row, n) for n, (_, f) in enumerate(lines) if f}
            total += len(lines)
    return rows, want, total


def test_unseen_sites(spark):
    rows, want, total = sites(60)
    pages = spark.createDataFrame(rows, "page_id bigint, site string, text string")
    crawls = spark.createDataFrame([], "crawl_id bigint, site string, facts string")
    got = {(r.row_id, r.line_no): r for r in boilerplate.judged(boilerplate.tree_rows(boilerplate.units(pages, crawls))).collect()}
    assert len(want) > 60 * 4 * 4
    assert len(want & set(got)) >= 0.9 * len(want) and len(want & set(got)) >= 0.97 * len(got)
    assert sum(r.by_tree for r in got.values()) >= 0.9 * len(got)


def test_copies_of_a_page_do_not_remove_its_lines(spark):
    rng = random.Random(3)
    text = "\n".join(sentence(rng) for _ in range(6))
    rows = [(i, "https://a.example/", text if i % 3 == 0 else "\n".join(sentence(rng) for _ in range(6))) for i in range(60)]
    rows += rows[:30]
    crawls = spark.createDataFrame([], "crawl_id bigint, site string, facts string")
    pages = spark.createDataFrame(rows, "page_id bigint, site string, text string")
    assert boilerplate.furniture(boilerplate.tree_rows(boilerplate.units(pages, crawls))).count() == 0
