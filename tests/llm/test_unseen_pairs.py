"""Answers in scripts, languages, wordings and lengths that the rules were not written for."""

import pytest

from brindle.llm import pairs

EN, PL, DE, ES = "Which oars are best on the coast?", "Które wiosła są najlepsze na wybrzeżu?", "Welche Ruder sind an der Küste die besten?", "¿Qué remos son los mejores en la costa?"
LANGUAGES = [
    (EN, "Лучшие вёсла сделаны из дерева, и они служат долго.", True), (EN, "最好的桨是木头做的，而且很耐用。", True), (EN, "Τα καλύτερα κουπιά είναι από ξύλο.", True), (EN, "أفضل المجاديف مصنوعة من الخشب.", True), (EN, "最高のオールは木でできています。", True), (EN, "가장 좋은 노는 나무로 만든다.", True),
    (EN, "Les meilleures rames sont en bois, et elles ne sont pas plus chères que les autres dans ce magasin.", True), (EN, "I remi migliori sono quelli di legno, e non sono più cari degli altri nella bottega.", True), (EN, "De beste riemen zijn van hout, en ze zijn niet duurder dan de andere in de winkel.", True), (EN, "Os melhores remos são de madeira, e não são mais caros do que os outros na loja.", True), (EN, "Nejlepší vesla jsou ze dřeva a nejsou dražší než ostatní, které se v obchodě prodávají.", True),
    (ES, "Les meilleures rames sont en bois, et elles ne sont pas plus chères que les autres dans ce magasin.", True), (PL, "Die besten Ruder sind aus Holz und nicht teurer als die anderen.", True), (DE, "Los mejores remos son de madera y no son más caros que los otros.", True), (EN, "The best oars are made of wood and last for years.", False), (PL, "Najlepsze wiosła są z drewna i nie są droższe od innych.", False), (DE, "Die besten Ruder sind aus Holz und nicht teurer als die anderen.", False), (ES, "Los mejores remos son de madera y no son más caros que los otros.", False),
    ("Translate into Russian: the oars are here.", "Вёсла лежат здесь, у воды.", False), ("Translate into French: the oars are in the house.", "Les rames sont dans la maison, et elles ne sont pas à nous.", False), ("Translate into Dutch: the oars are in the house.", "The oars are in the house of the neighbour.", True),
]
ENDINGS = [
    ("He said it twice (see the report.", "cut"), ("The best are long [as the makers say.", "cut"), ("She called them “long and light.", "cut"), ("Man nennt sie „lang und leicht.", "cut"), ("They are « longues et légères.", "cut"), ('They are known as "long and light.', "cut"), ("The oars are long and", "cut"), ("The oars are long,", "cut"), ("```\nx = 1", "cut"), ("First part.\n\nThe second part is about the", "cut"), ("Use the call f(a, {b: 1.", "cut"),
    ("He said it twice (see the report).", "whole"), ("She called them “long and light”.", "whole"), ("Man nennt sie „lang und leicht“.", "whole"), ("Nazywa się je „długie i lekkie”.", "whole"), ('They are 5" long.', "whole"), ("They are fine :(", "cut"), ("Good luck :) Bye.", "whole"), ("1) Long oars.\n2) Short oars.", "whole"), ("See https://a.example/x_(y", "whole"), ("```\nf(x\n```\nDone.", "whole"), ("The last line ends well!", "whole"),
]
REFUSALS = [
    "I won't answer that.", "I'm unable to give advice on this topic.", "Sorry, I can't discuss that. Please ask a specialist.", "I must decline to answer. Is there anything else?", "We are not permitted to provide this. Our policy forbids it, so it is left unanswered and I cannot say more.", "Nie mogę na to odpowiedzieć.", "Odmawiam odpowiedzi. Proszę zapytać specjalistę.", "Darüber darf ich nicht sprechen.", "Das kann ich leider nicht beantworten. Bitte fragen Sie eine Fachkraft.", "No puedo responder a eso.", "Lo siento, no se me permite hablar de ello.",
]
ANSWERS = ["I cannot lift these oars alone, for they weigh 9 kg.", "You can't go wrong with ash oars. They bend and last.", "Nie mogę się nachwalić tych wioseł. Są lekkie.", "Man kann nicht klagen: Die Ruder sind gut.", "No puedo quejarme: los remos son buenos y baratos."]


def test_languages():
    wrong = []
    for prompt, text, case in LANGUAGES:
        want, lang = pairs.expected_language(prompt, None), pairs.language(text)
        if bool(want and lang and want != lang) != case:
            wrong.append((prompt, text, want, lang))
    assert len(wrong) <= 0.1 * len(LANGUAGES), wrong


def test_endings():
    wrong = [(t, w) for t, w in ENDINGS if pairs.ending(t)[0] != w]
    assert len(wrong) <= 0.1 * len(ENDINGS), wrong


def test_refusals():
    wrong = [x for x in REFUSALS if not pairs.declines(x)] + [x for x in ANSWERS if pairs.declines(x)]
    assert len(wrong) <= 0.1 * (len(REFUSALS) + len(ANSWERS)), wrong


@pytest.mark.parametrize("times", [1, 40])
def test_defects_do_not_depend_on_length(times):
    refusal, tail = " ".join(["I cannot help with that request."] * times), " The oars are long and light." * (60 * times)
    assert pairs.declines(refusal) and pairs.ending(tail.strip() + " They are (see above.")[0] == "cut" and pairs.ending(tail.strip())[0] == "whole"
    assert pairs.copies("\n".join([EN] * times), EN) and pairs.is_empty("<br>" * times)
