import json

import pytest

from brindle.llm import abuse, boilerplate, pairs, residue

BODY = "About 17 percent of all spokes weigh less than mudguards, although the price rose in spring and delivery takes longer."


@pytest.mark.parametrize("text", [
    "Error 404 - page not found", "404\nPlease try again in a few minutes.", f"{BODY}\nLoading…\n{BODY}", "Menu | Shop\nWłącz JavaScript, aby zobaczyć tę stronę.", "Hello undefined, your roof hooks ship on Invalid Date.", "From NaN EUR per set of mounting rails",
    "Lorem ipsum velit porta felis vitae nibh tellus", "xxxxx xxxxx xxxx", "Costs %firstName% a {{headline}}", f"{BODY} Nikt {{% name %}} nie wie.", "ZBYT WIELE ZAPYTAŃ", "Inhalt folgt", "[[city]]", "<%= title %>", "Seitentitel\nInhalt folgt",
])
def test_residue(text):
    assert residue.text_messages(text)


@pytest.mark.parametrize("text", [
    None, "", " \n ", BODY, "A helpful 404 page keeps visitors, so we compared how twelve shops word theirs. " + BODY, "W szablonie listu wpisz {{ imie }}, a program sam wstawi imię. " + BODY, "The variable stays undefined until the form is sent, as the next example shows.",
    "Designers once filled every draft with lorem ipsum; we asked three of them why.", "Visitors with JavaScript switched off still reached all of our sitemaps.", f"{BODY} {BODY}\n* Seitentitel\nSeitentitel\nSitemaps", "See [1] and [Brackets](https://a.example).", "In 2024 errors fell by 5 %. " + BODY,
])
def test_no_residue(text):
    assert not residue.text_messages(text)


@pytest.mark.parametrize("diff,case", [
    ({"rawTitle": "undefined", "renderedTitle": "Real title"}, False), ({"rawTitle": "undefined", "renderedTitle": None}, True), ({"renderedTitle": "Access denied | Shop"}, True), ({"renderedTitle": "Why {{ name }} works in mail templates"}, False),
    ({"renderedTitle": "Undefined deadlines and how to fix them"}, False), ({"linksOnlyInRendered": ["https://a.example/p/{{slug}}"]}, True), ({"linksOnlyInRendered": ["https://a.example/undefined/undefined"]}, True), ({"linksOnlyInRendered": ["https://a.example/a?page=3", None, 4]}, False), ([], False),
])
def test_render_diff(diff, case):
    assert bool(residue.diff_messages(json.dumps(diff))) == case
    assert not residue.diff_messages(json.dumps(diff)[:-1])


def test_weak_messages_need_sources(spark):
    pages = spark.createDataFrame([(i, f"https://s{i % n}.example/", t) for i, (n, t) in enumerate([(9, "Gateway error, retry")] * 4 + [(1, "Odd script thing")] * 4)], "page_id bigint, site string, text string")
    crawls = spark.createDataFrame([], "crawl_id bigint, site string, render_diff string")
    got = {r.row_id for r in residue.flagged(residue.messages(residue.units(pages, crawls))).collect()}
    assert got == {0, 1, 2, 3}


def test_weak_lines_and_titles_of_any_length(spark):
    long = "The checkout gateway gave an error while it was talking to the upstream of the shop, " * 3 + "retry the step."
    texts = [long, f"{BODY}\nOrder gateway error, retry the step\n{BODY}", f"{BODY}\nCommon errors\n* Order gateway error, retry\n{BODY}", BODY]
    pages = spark.createDataFrame([(10 * k + i, f"https://s{i}.example/", t.replace("17", str(i))) for k, t in enumerate(texts) for i in range(4)], "page_id bigint, site string, text string")
    crawls = spark.createDataFrame([(i, f"https://s{i % n}.example/", json.dumps({"renderedTitle": t})) for i, (n, t) in enumerate([(9, "Order gateway error | Shop")] * 4 + [(1, "Odd loading thing | Shop")] * 4 + [(9, "Life with JavaScript switched off")] * 4)], "crawl_id bigint, site string, render_diff string")
    got = {(r.src[:1], r.row_id) for r in residue.flagged(residue.messages(residue.units(pages, crawls))).collect()}
    assert got == {("e", 10 * k + i) for k in range(2) for i in range(4)} | {("c", i) for i in range(4)}


def test_long_line_that_starts_with_a_message():
    assert residue.text_messages("404 Not Found. The page you asked for is not on this server. " + BODY + " " + BODY)
    assert not residue.text_messages("404 pages help visitors. " + BODY + " " + BODY)


MENU = "Home | Shop | Blog | Contact"


def code(i):
    return "".join("abcdefghij"[int(d)] for d in str(i)) + "x"


def _site(spark, rows):
    p = spark.createDataFrame(rows, "page_id bigint, site string, text string, host string")
    c = spark.createDataFrame([(1, "https://c.example/", json.dumps({"text": f"{MENU}\n{BODY}"})), (2, "https://c.example/", '{"text": "Home | Shop'), (3, "https://c.example/", "[]"), (4, "https://c.example/", None)], "crawl_id bigint, site string, facts string")
    u = boilerplate.units(p, c)
    return u, boilerplate.furniture(boilerplate.tree_rows(u))


def test_boilerplate(spark):
    rows = []
    for i in range(60):
        lines = ["Zebra corner of the site", MENU, f"Title {code(i)} of the day", BODY + code(i), "", "Care and storage" if i % 6 == 0 else "* Fenders", "Our oat cookies need twelve minutes and a cool tray.", "We use cookies to count visits. OK, got it", "Related: Choosing oars", "© 2024 Site. All rights reserved."]
        rows.append((i, "https://a.example/", "\n".join(lines), "x"))
    rows += [(100, "https://a.example/", None, "x"), (101, "https://a.example/", " \n", "x"), (102, None, "Only line", "x")]
    u, gone = _site(spark, rows)
    got = {(r.src, r.row_id, r.line_no) for r in gone.collect()}
    assert {n for s, i, n in got if i == 5} == {0, 1, 6, 7, 8, 9}
    assert ("crawl_page", 1, 0) in got and not any((s, i) in {('crawl_page', 2), ('crawl_page', 3), ('crawl_page', 4), *(('existing_page', n) for n in (100, 101, 102))} for s, i, _ in got)
    body = {(r.src, r.row_id): r.body for r in boilerplate.main_text(u, gone).collect()}
    assert body["crawl_page", 1] == BODY and "We use cookies" not in body["existing_page", 5] and "Title fx of the day" in body["existing_page", 5]


SHIPPING = "Orders placed before noon leave our warehouse on the same working day, and returns are free for thirty days."


def test_tree_decides_sentences_items_and_long_lines(spark):
    menu, notice = " | ".join(f"Range {code(i)}" for i in range(40)), "Please note the summer rules of the yard, " * 8 + "thank you."
    rows = [(i, "https://a.example/", "\n".join([SHIPPING, menu, notice, "* Call the yard", BODY + code(i), f"* Fender {code(i)}"]), "x") for i in range(60)]
    got = {(i, n) for s, i, n in _site(spark, rows)[1].collect() if s == "existing_page"}
    assert got == {(i, n) for i in range(60) for n in range(4)}


def test_long_notice():
    assert boilerplate.style_rule("We use cookies to remember the basket and to count visits on all pages of the shop, to see which of them are read and which of them are not, and to show the prices of your country and the stock of the shop that is next to you, at any time of the year") is True
    assert boilerplate.style_rule(BODY + " " + BODY + " " + BODY + " We use cookies in the bakery.") is None


@pytest.mark.parametrize("line", ["Help / Receipts / 2 notes on invoices", "Tags: forms, statements", "Share | Save | Print", "You might also like How registers fit", "Beliebt in dieser Woche: Decken", "Join our newsletter and get 5 percent off", "Office hours Mon-Fri 9-17, unit 31, Harbour Yard", "Mapa strony | Kariera | Dla prasy"])
def test_furniture_styles(line):
    assert boilerplate.style_rule(line) is True


@pytest.mark.parametrize("line", ["* Fenders", BODY, "- Light roasts", "Our oat cookies need twelve minutes and a cool tray before anyone packs them."])
def test_body_styles(line):
    assert boilerplate.style_rule(line) is not True


DEFECTS = [
    ("Which oars are best?", "I am sorry, but I cannot help with that request.", None, "refusal"),
    ("Which oars are best?", "Good oars are long.", "SAFETY", "refusal"),
    ("Welche Anker sind gut?", "Dabei kann ich nicht helfen. Meine Vorgaben lassen das nicht zu.", None, "refusal"),
    ("Which oars are best?", "```\n```", None, "empty"),
    ("Which oars are best?", None, None, "empty"),
    ("Which oars are best?", "N/A", None, "empty"),
    ("Which oars are best?", "> which oars are best", None, "copy"),
    ("Czy wiosła mają sens?", "Pytanie: Czy wiosła mają sens? ", None, "copy"),
    ("Which oars are best on the coast?", "Das Lager trennt die Ruder und die Anker, weil die Rücksendungen kostenlos sind.", None, "language"),
    ("Translate into German: the oars are here.", "The oars are in the house of the neighbour.", None, "language"),
    ("Which oars are best on the coast?", "The long oars are best, because the", None, "truncated"),
    ("Which oars are best on the coast?", "The long oars are the best.\n\n```\n<a href='/x'>", None, "truncated"),
    ("Which oars are best on the coast?", "The long oars are the best.\n\n- Oars\n- Moo", None, "truncated"),
    ("Which oars are best on the coast?", "Ruder, Anker", None, "language"),
    ("Which oars are best on the coast?", "I can't see your budget, but here is what helps most. The long oars are best.", None, None),
    ("Which oars are best on the coast?", "The long oars are the best.\n\n- Oars\n- Moorings", None, None),
    ("Which oars are best on the coast?", "Which oars are best on the coast?\n\nThe long ones are the best.", None, None),
    ("Which oars are best on the coast?", "The long ones are the best.\n\n[1] https://a.example/oars", None, None),
    ("Which oars are best on the coast?", "Oars, moorings", None, None),
    ("Translate into German: the oars are here.", "Die Ruder sind hier und nicht dort.", None, None),
]


def test_pairs(spark):
    lex = [("l", "en", i, "The list is here for all of you.\n\n- Oars\n- Moorings\n- Anchors\n- Oars", None) for i in range(3)] + [("l", "de", i, "Die Liste ist hier und nicht dort.\n\n- Ruder\n- Anker\n- Segel\n- Ruder", None) for i in range(3)]
    rows = [("r", f"p{i}", 0, a, r) for i, (_, a, r, _) in enumerate(DEFECTS)]
    prompts = [(f"p{i}", p, "en" if i % 2 else None) for i, (p, *_) in enumerate(DEFECTS)] + [("en", "What is in the list for us?", "en"), ("de", "Was ist in der Liste und was nicht?", "de")]
    a = spark.createDataFrame(rows + rows[:2] + lex + [("r", "unknown", 1, "The text of it.", None)], "run string, prompt string, run_index int, text string, refusal string")
    p = spark.createDataFrame(prompts + prompts[:1], "prompt string, text string, locale string")
    got = {r.prompt: r.defect for r in pairs.found(a, p).collect()}
    assert got == {f"p{i}": d for i, (*_, d) in enumerate(DEFECTS) if d}
    assert pairs.found(a.limit(0), p).count() == 0


def test_defects_at_any_length():
    prompt = "Which oars are the best ones for a long trip along the windy coast?"
    assert pairs.copies("\n".join([prompt] * 9), prompt) and pairs.copies(" ".join([prompt] * 9), prompt) and not pairs.copies(" ".join([prompt] * 9 + ["Long ones."]), prompt)
    assert pairs.is_empty("<p>&nbsp;</p>\n" * 60) and not pairs.is_empty("<p>&nbsp;</p>\n" * 60 + "Oars")
    refusal = ["I am sorry, but I cannot help with that request.", "I cannot discuss this " + "or anything of the kind " * 9 + "with you."] + ["My guidelines do not allow it, and I am not able to answer."] * 9
    assert pairs.declines(" ".join(refusal)) and not pairs.declines(" ".join([*refusal, "The long oars are the best."]))


ABUSE = [
    "Listen, only a worthless clown could write this - get lost.", "D e a r a u t h o r , what a w o r t h l e s s little idiot you a-r-e-", "Everybody kn0ws th4t s0m3b0dy should bvrn the houses of Ostrovites", "n**xt t**me I see you I w*ll break your f*gers",
    "souuutherners are vermin, and I willllll say it agaiiiin", "Słuchaj, wypierdalaj stąd!", "Hör zu, verpiss dich, Vollpfosten.", "Mira, ojalá te pudras, idiota", "Psst, he tore off her bra and licked her nipples", "mujeres mojadas sin censura", "Go drоwn in your own filth", "verp&#105;ss dich", "ve​rpiss dich",
]
CLEAN = [
    None, "", " ", BODY, "great tits and blue tits visit the garden feeder in winter.", "Our moderation guide says that calling a member an idiot leads to a warning.", "Kill the hung crawler process and shoot a mail to the night shift.", "This damn pump died again, what a stupid valve.",
    "A report on hate speech quotes the word vermin twice and condemns it.", "Strip the cable, screw it tight and mount the cock valve.", "The clinic page on breast screening and sexual health needs a shorter title.", "The bastard file is a coarse file for metal edges.", "Regulamin mówi, że nazwanie kogoś idiotą kończy się ostrzeżeniem.",
]


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(text):
    assert abuse.text_score(text) >= abuse.THRESHOLD and abuse.text_score(f"{BODY} {text} {BODY}") >= abuse.THRESHOLD


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert abuse.text_score(text) < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["The people of the coast are not thieves by birth, as anyone there knows.", "Those migrants aren't thieves by birth.", "They are not vermin.", "Sie sind keine Parasiten.", "No son una plaga."])
def test_denial(text):
    assert abuse.text_score(text) < abuse.THRESHOLD <= abuse.text_score(f"{text} They are vermin.")


@pytest.mark.parametrize("text", ["They are not only thieves by birth", "No, you are an idiot", "They do not deserve our air", "Nie jestes nic wart"])
def test_no_denial(text):
    assert abuse.text_score(text) >= abuse.THRESHOLD


def test_second_match_of_a_rule():
    quoted = "a report says that they are vermin and condemns it " + "and then the price of oars rose in spring " * 4
    assert abuse.text_score(quoted) < abuse.THRESHOLD <= abuse.text_score(quoted + "they are vermin")


def test_long_spaced_run():
    text = "you worthless little idiot " * 5
    assert len(text.replace(" ", "")) > 80 and abuse.text_score(" ".join(text.replace(" ", ""))) >= abuse.THRESHOLD


def test_rates(spark):
    docs = spark.createDataFrame([(1, ABUSE[0], "a", 1.0), (2, BODY, "a", 1.0), (3, None, None, 1.0)], "doc_id bigint, text string, source string, score double")
    src = spark.createDataFrame([("a", "c"), ("b", "c")], "source string, channel string")
    got = {r.source: (r.documents, r.cases, r.rate) for r in abuse.rates(abuse.scored(docs, keep=("source",)), src).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None), None: (1, 0, 0.0)}
    assert abuse.scored(docs.limit(0)).count() == 0
