"""Messages and real sentences whose wording no rule of the library was written for."""

from brindle.llm import residue

CASES = [
    "Sorry, this content isn't available right now", "HTTP Status 404 – The requested resource is not here", "[Insert company name]", "Nie masz uprawnień do wyświetlenia tej strony", "We couldn't load this page. Please refresh.", "Whoops, that link is broken!", "This document has been removed or is temporarily unavailable.",
    "500 | Server Error", "You do not have permission to access this resource.", "The connection to the database was refused", "Our servers are overloaded at the moment, please come back later.", "This site can't be reached", "Sorry! We can't find that page.", "Request failed with status code 503", "Your account has been suspended", "An unhandled exception occurred while processing your request.",
    "Ta strona została usunięta lub przeniesiona.", "Wystąpił nieoczekiwany błąd serwera.", "Przepraszamy, serwis jest chwilowo niedostępny", "Nie udało się załadować treści. Spróbuj ponownie.", "Brak uprawnień do tego zasobu", "Die angeforderte Seite existiert nicht mehr.", "Diese Seite ist zurzeit nicht erreichbar", "Der Server ist momentan überlastet, bitte später erneut versuchen.", "Sie haben keine Berechtigung, diese Seite zu sehen.", "Verbindung zum Server fehlgeschlagen",
    "Lo sentimos, la página solicitada no existe", "El servidor no está disponible en este momento", "No tiene permiso para acceder a este recurso.", "Ha habido un error inesperado, vuelva a intentarlo", "No se pudo establecer la conexión", "This website requires scripts: please allow them in your browser", "JavaScript must be enabled to use this application", "Please activate scripting in your browser settings", "Ta aplikacja wymaga włączonej obsługi JavaScript", "Aktivieren Sie JavaScript in Ihrem Browser", "Para ver esta página debe habilitar JavaScript",
    "Please wait while we load the page", "Page is loading, please wait a moment", "Trwa wczytywanie strony", "Die Seite wird geladen, bitte warten", "La página se está cargando", "Type your description here", "Enter a title for this page", "Replace this sample text with your own content", "Write your content here", "Paragraph text goes here. Edit this.", "Wstaw tutaj swój opis", "Dodaj tutaj treść strony", "Fügen Sie hier Ihren Text ein", "Hier bitte die Beschreibung einfügen", "Inserte aquí la descripción", "Escriba su texto en este espacio",
    "This section is under construction", "TBD: description", "Draft: content to follow", "Dear {{client_first_name}}, thank you", "Your order ${order.id} has shipped", "Price: NaN EUR", "Hello [your name], welcome back", "<% customer.city %> weather", "Ships to %%CITY%% in days {{days_left}}", "undefined undefined", "Total: [object Object]",
]
REAL = [
    "How our shop cut its not-found pages by half in one summer", "The old server room now serves as a bakery with three ovens.", "Why visitors trust a page that loads in one second", "Seven errors that new gardeners make with tomato seedlings", "The editor denied that the award had been bought by a rival", "A blocked drain is easier to clear with a long steel brush than with acid.",
    "The gateway to the valley was closed by snow until the middle of April.", "Our baker apologised for the burnt loaves and handed out rolls instead.", "Scripts for the school play were written by pupils of the third form.", "The theatre keeps every script of the last forty seasons in a dry cellar.", "Loading a dishwasher well saves a third of the water each week.", "Waiting times at the clinic fell after two nurses joined the team.",
    "Błędy ortograficzne w listach dziecka mówią wiele o jego nauczycielach.", "Serwis rowerów przed sezonem kosztuje mniej niż nowy łańcuch.", "Fehlersuche an alten Radios macht dem Verein seit Jahren Freude.", "Die Wartung der Heizung kostet im Herbst mehr als im Frühling.", "El mantenimiento de las bicicletas del barrio corre a cargo de dos vecinos.", "Los errores del árbitro decidieron el partido del domingo.",
    "Titles, headings and descriptions: what readers see first on a phone", "A good headline names the tool and the person who used it.", "Insert the long bolt from the left and tighten the nut by hand.", "Click beetles jump when they are turned on their backs.", "The museum's missing statue was found in a barn near Lyon.", "Access to the beach is free for residents and costs two euros for guests.",
    "The session of the council lasted until midnight because of the harbour budget.", "Your first sourdough needs patience, warm hands and a heavy pot.", "No fish was found in the lake after the hot summer of that year.", "She could not find the page with the recipe, so she cooked from memory.", "The site of the old mill is now a garden with two hundred roses.", "Under the new bridge, construction workers found a Roman oven.",
]


MENUS = ["Laden", "Startseite · Kontakt · Laden", "Home | Contact | Support", "Home / Help / Contact", "Errores", "Fehler", "Kontakt", "Start > Kontakt", "Maintenance"]


def test_menus_and_headings_are_no_messages():
    assert not [x for x in MENUS if _flagged(x)] and _flagged("Error 404") and _flagged("Too many requests") and _flagged("DO UZUPEŁNIENIA") and _flagged("Sorry, we could not find what you were looking for")


def _flagged(text):
    return any(certain for *_, certain in residue.text_messages(text))


def test_unseen_messages():
    missed = [x for x in CASES if not _flagged(x)]
    assert len(CASES) >= 60 and len(missed) <= 0.1 * len(CASES), missed


def test_unseen_real_sentences():
    wrong = [x for x in REAL if _flagged(x)]
    assert len(wrong) <= 0.05 * len(REAL), wrong


def test_long_and_short_forms_agree():
    body = "About 17 percent of all spokes weigh less than mudguards, although the price rose in spring and delivery takes longer. " * 30
    for x in ("404 - page not found.", "Please enable JavaScript to view this page.", "Sorry, this content is not available.", "Dear {{name}},"):
        assert _flagged(x) and _flagged(f"{x} {body}") and _flagged(f"{body}\n{x}\n{body}")
