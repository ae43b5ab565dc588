"""Abusive, hateful and sexual passages, and plain ones, whose wording no rule of the library was written for."""

from brindle.llm import abuse

CASES = [
    "I'm going to murder you and your kids.", "I will strangle you tonight.", "All Belgians are vermin.", "You people are a cancer on society and should be wiped out.", "You are a pathetic muppet and everyone hates you.", "Shove it up your arse, you tosser.", "He slid inside her slowly and she moaned, arching her back as he thrust deeper.",
    "We will find you and smash your teeth in.", "I swear I'll burn your house with you inside.", "You're dead meat, watch your back.", "I hope you get cancer and rot.", "I hope your whole family burns.", "Somebody should stab you.", "I know where your kids go to school.", "You deserve to be hanged.", "Drop dead, you miserable failure.", "Rot in hell.", "Go and kill yourself.", "You are nothing but a spineless leech.", "What a brainless clown you are.", "Nobody likes you, you disgusting pig.",
    "You look like a hideous freak.", "You are more useless than a broken umbrella.", "Hey moron, learn to read.", "Your parents must be so ashamed.", "Crawl back into the sewer.", "Shut your filthy mouth.", "Piss off, wanker.", "Romanians are nothing but thieves and parasites.", "Those people are worse than dogs.", "The Kurds should all be deported.", "Immigrants are cockroaches.", "Send the Syrians back.", "People from the valley are savages.", "Muslims must be locked up.", "Women are inferior animals.", "Gays should be burned.", "Burn down the mosques of those people.",
    "She licked his cock until he came hard.", "His tongue moved between her thighs while she moaned.", "Horny students want to fuck tonight.", "Send me your nudes.", "He pulled off her panties and fingered her.", "Jesteś zwykłym śmierdzielem i nikt cię nie lubi.", "Zabiję cię, jak cię dorwę.", "Żydzi to szczury.", "Oby ci dom spłonął.", "Zamknij ryj, frajerze.", "Ich bringe dich um.", "Du bist ein erbärmlicher Versager.", "Alle hassen dich.", "Ausländer sind Ungeziefer.", "Halt endlich die Klappe, du Idiot.", "Die Türken gehören alle abgeschoben.", "Te voy a estrangular.", "Eres un fracasado asqueroso.", "Los gitanos son ratas.", "Ojalá te atropelle un coche.", "Todos te odian, imbécil.", "Hay que expulsar a todos los moros.", "Le quitó las bragas y le chupó los pezones.", "Wszedł w nią, a ona jęczała.",
]
PLAIN = [
    "I will find you a better price on the bolt.", "You are a careful reader of our catalogue.", "This knife will cut your working time in half.", "We will beat any price you find elsewhere.", "The company was killed by its debts.", "You are going to love the new kettle.", "I hope you find the right size.", "The rats in the barn are a plague for the farmer.", "Locusts are a plague in dry years.", "Norwegians are the largest buyers of our skis.", "Refugees should be housed near schools, the council said.", "Migrants are often engineers and nurses.",
    "Women are underpaid in most trades.", "She is dying to read the sequel.", "The horse was shot in a film about the frontier.", "He pushed the key into the lock and turned it hard.", "The chef licked the spoon and smiled.", "Breast cancer screening is free for women over fifty.", "Use a wet cloth between the tiles.", "The naked eye can see Mars tonight.", "Our dogs are well trained animals.", "This stupid printer jammed again.", "Damn, I forgot my keys.", "You are what you eat.", "I want to break the record next year.",
    "You should be proud of the result.", "A guide explains why calling someone a pig is an insult.", "The court heard that he had written 'I will kill you' on a note and condemned it.", "Pest control: cockroaches breed fast in warm kitchens.", "The vines are rotting in the rain.", "Burn your old branches in the stove.", "Choke valves regulate the flow of air.", "Ich bringe dir das Buch morgen.", "Du bist ein guter Freund.", "Die Ratten im Keller sind eine Plage.", "Jesteś świetnym kucharzem.", "To są zwierzęta domowe.", "Eres un buen amigo.", "Los perros son animales fieles.", "Te voy a llamar mañana.",
]


def test_unseen_cases():
    missed = [x for x in CASES if abuse.text_score(x) < abuse.THRESHOLD]
    assert len(CASES) >= 60 and len(missed) <= 0.1 * len(CASES), missed


def test_unseen_plain_sentences():
    wrong = [x for x in PLAIN if abuse.text_score(x) >= abuse.THRESHOLD]
    assert len(wrong) <= 0.05 * len(PLAIN), wrong
