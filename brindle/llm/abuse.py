"""Problem 10: a score for abusive, hateful or sexual content, and rates by source.

A weighted finite-state pattern grammar, composed of five transducers that run one after the other over each text:

1. spelling: folds case, accents, look-alike letters, digits used as letters, masked letters (``sc*m``), stretched and
   spaced-out words to plain words; what is ambiguous is decided by the grammar's own vocabulary;
2. clauses: cuts the folded text into clauses of words;
3. patterns: regular patterns over word classes (insults, threats, targets, groups, sexual acts) with weights. A class
   alone weighs little; a pattern needs its target: somebody addressed, a group of people, a person acted on;
4. negation: a pattern whose predicate is denied ("are not thieves by birth") says nothing;
5. context: reported speech, rules that name a word, medical and technical words lower the score of the clause.

The score of a text is that of its best clause plus a part of the others; a text is a case from ``THRESHOLD``, that is,
with one clause that is abusive by itself. Texts are scored in one pass without a shuffle; rates are a combinable
aggregate by source, so a source with a third of all rows costs nothing extra.

Defined cases: null, empty and blank texts score 0; documents with a null or unknown source count under a null source.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, spread

#: Score from which a text is a case; share of the other clauses in the score of a text.
THRESHOLD, REST = 3.0, 0.1

# --- word classes (folded spelling) --------------------------------------------------------------------------------

CLASSES = {
    # nouns that insult a person
    "I": "scumbags? bastards? morons? idiots? cretins? imbeciles? losers? clowns? parasites? pigs? dickheads? assholes? arseholes? bitch(?:es)? whores? sluts? cunts? wankers? tossers? twats? pricks? fuckers? motherfuckers? retards? dumbass(?:es)? jackass(?:es)? douchebags? dipshits? fools? trash garbage vermin cowards? lowlifes? dimwits? halfwits? simpletons? muppets? bellends? gits? creeps? rats? maggots? cockroach(?:es)? degenerates? freaks? failures? nobod(?:y|ies) disgraces? swine skanks? buffoons? numpt(?:y|ies) shitheads? pigheads? imbecile leech(?:es)?"
    " idioto debilu kretynie palancie dupku smieciu gnoju pasozycie tchorzu glupku durniu baranie chuju kutasie skurwysynu sukinsynu szmato suko dziwko kurwo gnido pajacu frajerze bydlaku matole tumanie cwelu pedale swinio idiotko debilko scierwo lajzo gnojku polglowku prostaku nieudaczniku zlamasie lamusie oszolomie kanalio"
    " schwachkopf vollpfosten trottel parasit drecksack arschloch feigling idiot idiotin wichser hurensohn missgeburt schlampe hure fotze penner spast spasti vollidiot dummkopf abschaum drecksau schwein versager blodmann nichtsnutz dreckskerl mistkerl bastard depp deppen lappen hohlkopf hampelmann mistkafer ratte arsch schwachmat holzkopf"
    " idiota imbecil payaso payasa parasito cobarde estupido estupida gilipollas cabron cabrona subnormal capullo mierda puta puto hijoputa tarado basura escoria cretino cretina inutil cerdo cerda zorra retrasado maricon rata fracasado pendejo pendeja baboso mamarracho bastardo malnacido sinverguenza gusano",
    # adjectives that insult, and those that insult by themselves whatever follows
    "A": "worthless pathetic ugly disgusting useless brainless spineless greasy filthy lying stupid dumb fucking bloody damn miserable rotten stinking little fat lazy vile dirty sick cowardly idiotic moronic goddamn shitty complete total absolute utter silly old pitiful hideous"
    " glupi glupia zalosny zalosna zaklamany zaklamana tepy tepa bezmozgi bezmozga smierdzacy smierdzaca obrzydliwy parszywy parszywa jebany jebana pierdolony pierdolona zasrany brudny nedzny wstretny"
    " verlogener verlogene hirnloser hirnlose erbarmlicher erbarmliche widerlicher widerliche dreckiger dreckige dummer dumme fetter fette blode bloder hassliche hasslicher armseliger nutzloser elender verdammter stinkender wertloser"
    " inutil mentiroso mentirosa patetico patetica asqueroso asquerosa estupido estupida feo fea sucio sucia maldito maldita puto puta gordo gorda repugnante descerebrado descerebrada miserable",
    "B": "worthless pathetic disgusting brainless spineless stupid moronic idiotic repulsive pitiful vile filthy lying hideous zalosny zalosna bezmozgi obrzydliwy zaklamany parszywy zalosnym bezmozgim tepym hirnloser hirnlose erbarmlicher erbarmliche widerlicher widerliche verlogener armseliger wertloser patetico patetica asqueroso asquerosa repugnante descerebrado descerebrada mentiroso",
    # what hurts: to do it, and to have it done
    "H": "kill murder strangle stab shoot beat break smash crush burn hurt cut slit slap punch choke hang drown gut skin torture rape maim bury poison whip kick bash destroy cripple slaughter butcher lynch behead end finish find hunt wreck",
    "P": "killed murdered strangled stabbed shot beaten burned burnt hurt slapped punched hanged hung drowned gutted whipped kicked gassed lynched tortured exterminated eradicated executed deported driven expelled shipped locked caged sterili[sz]ed flogged slaughtered exterminated castrated thrown removed purged stoned jailed wiped",
    # what people are called who are denied to be human
    "D": "vermin rats? roaches cockroach(?:es)? animals beasts pigs dogs monkeys apes parasites leeches maggots lice filth scum trash garbage savages subhumans? subhuman degenerates disease plague cancer virus pestilence infestation stain thieves criminals rapists murderers invaders barbarians"
    " robactwo robactwem zaraza zaraze szarancza plaga plage zlodzieje zlodziejami podludzie podludzmi zwierzeta zwierzetami pasozyty pasozytami smiecie smieciami bydlo bydlem bandyci dzicz dzikusy szczury szczurami karaluchy rak rakiem brud"
    " ungeziefer plage seuche abschaum parasiten ratten untermenschen tiere diebe verbrecher tier dreck schmarotzer barbaren schadlinge krebsgeschwur pest affen"
    " alimanas plaga peste escoria ratas parasitos basura infrahumanos ladrones animales enfermedad delincuentes criminales salvajes cucarachas cancer bestias sabandijas",
    # peoples and other groups: kinds of people, and names of peoples by their endings
    "G": "migrants? immigrants? foreigners? refugees? newcomers? jews? muslims? christians? arabs? gyps(?:y|ies) roma gays? lesbians? women blacks? whites? poles? they those these"
    " migranci imigranci uchodzcy obcy przyjezdni zydzi muzulmanie cyganie geje kobiety arabowie gorale oni ludzie"
    " migranten auslander fluchtlinge zugezogenen? juden muslime zigeuner schwule frauen araber leute polen bergler turken sie"
    " migrantes inmigrantes extranjeros refugiados judios musulmanes gitanos mujeres gente moros negros chinos serranos montaneses ellos",
    # the body, and what is done with it
    "S": "pussy pussies cunt tits boobs nipples nipple cock dick dicks penis vagina clit ass asshole blowjob handjob cum cumming orgasm fuck fucks fucking fucked sex porn porno nude nudes naked horny panties bra slut sluts busty milf anal erection"
    " cipke cipka cipki cycki cyckow kutas kutasa penisa pieprzyc pieprzy ruchac rucha jebac porno porn seks nagie naga nagi nago golych napalone napalona stanik majtki dupe lodzik orgazm"
    " muschi titten schwanz ficken fickt gefickt porno porn sex nackt nackte nackten nacktbilder geile geil geiler bh hoschen bruste nippel schlampen votze orgasmus"
    " cono tetas polla follar follan follando folla porno porn sexo desnuda desnudas desnudo cachondas cachonda cachondo sujetador bragas pezones culo orgasmo mamada zorras",
    "N": "nipples? breasts? pussy cunt cock dick penis clit tits boobs thighs crotch groin ass arse panties bra erection shaft buttocks cipke cipka cycki kutasa? uda sutki stanik majtki piersi posladki muschi titten schwanz bruste brustwarzen schenkel hoschen bh nippel schritt cono tetas polla pezones muslos bragas sujetador pechos nalgas",
    "V": "lick(?:ed|s|ing)? suck(?:ed|s|ing)? strok(?:e|ed|es|ing) thrust(?:ed|s|ing)? rode straddl(?:e|ed|es|ing) fondl(?:e|ed|es|ing) finger(?:ed|ing) fuck(?:ed|s|ing)? moan(?:ed|s|ing)? climax(?:ed|es|ing)? orgasm(?:s|ed)? penetrat(?:e|ed|es|ing) ejaculat(?:e|ed|es|ing) undress(?:ed|es|ing)? came naked soaked wet horny grop(?:e|ed|es|ing)"
    " lizal\\w* ssal\\w* jecz\\w* pieprzy\\w* rucha\\w* pieszcz\\w* naga nago nagi napalon\\w* mokr\\w* dochodzil\\w* wszedl wchodzil leckt\\w* saugt\\w* stohn\\w* fick\\w* gefickt streichelt\\w* nackt\\w* feucht\\w* nass geil\\w* stiess lami\\w* chup\\w* gim\\w* foll\\w* acarici\\w* desnud\\w* mojad\\w* empapad\\w* cachond\\w* penetr\\w* gemi\\w*",
}


def _alt(name: str) -> str:
    # words of a class are parted by blanks; blanks inside a group belong to one phrase
    return "(?:" + "|".join(sorted(set(CLASSES[name].split()), key=len, reverse=True)) + ")"


#: Animals and plants, which may be called so.
_BEASTS = r"(?:ratt|maus|wesp|muck|schneck|taub|insekt|kafer|unkr|lause|hund|katz|pferd|tier|vog|fisch|pflanz|kakerlak|perr|gat|caball|animal|pajar|insect|rat[ao]|moscas|mosquit|hormig|cucarach|palom|plant|gusan|conej|gallin|vac|ovej|peces|malas)"

#: Names of peoples by their endings (plural), and people by place or faith.
_PEOPLES = (
    r"|(?:those |these |the |all )?\w+(?:ians|eans|ites|erners|landers|comers|ishmen|immigrants)|(?:all |the |those )?(?:belgians|germans|russians|americans|mexicans|asians|turks|danes|swedes|greeks|serbs|croats|kurds|chinese|japanese|french|portuguese)|(?:(?!sorry|not)\w+ )?people (?:of|from) (?:\w+ )?\w+|(?:the |those |these |that )(?:\w+ )?(?:people|lot|kind|folk)"
    r"|\w{3,}(?:anie|ianie|ici|owie|czycy|niacy)|ci (?:z|ze) \w+|ludzie (?:z|ze|tej|tamtej) \w+|ci ludzie"
    r"|\w{3,}(?:ier|iten|aner|esen|landern?)|(?:die )?(?:aus|von) (?:dem |der )?\w+|leute (?:dieses|jenes|aus|von) (?:dem )?\w+|diese leute|die (?!{BEAST})\w{4,}"
    r"|(?:los|las) (?!{BEAST})\w{4,}|(?:los|las) (?:de|del) (?:esa |esta )?\w+|(?:la )?gente (?:de|del) (?:esa |esta )?\w+|esa gente|recien llegados"
)
_GROUP = _alt("G")[:-1] + _PEOPLES.replace("{BEAST}", _BEASTS) + ")"
_INSULT = _alt("I")[:-1] + r"|pieces? of (?:shit|crap|garbage|trash|filth)|waste of (?:air|space|oxygen|skin|breath)|(?:letzte[rn]? )?dreck|sons? of bitches)"
_ADJ, _BARE, _HARM, _DONE, _LESS = _alt("A"), _alt("B"), _alt("H"), _alt("P"), _alt("D")
_SEX, _INTIMATE, _ACT = _alt("S"), _alt("N"), _alt("V")
_YOU = r"(?:you|u|ya|ye)(?: people| guys| all| lot| two)?"
_ARE = r"(?:are|re|r|were|will always be|look like|sound like)"
_SHOULD = r"(?:should|ought to|deserves? to|needs? to|must|has to|have to)(?: all| just| only)?"

#: (weight, pattern) over the words of a clause; the names in braces are classes. Each pattern composes open classes: who
#: speaks, to or about whom, and what is said.
_RULES: list[tuple[float, str]] = [
    # --- insults: somebody addressed, and a noun or adjective that insults
    (3, r"\b{YOU} {ARE}(?: \w+)?(?: just| nothing but| such| all| really| only| nothing more than)? ?(?:an? |an? |the |one |some )?(?:\w+ )?(?:{A} )*{I}\b"),
    (3, r"\b{YOU} {ARE}(?: \w+)? (?:an? |the )?(?:{A} )*{B}(?: \w+)?\b"),
    (3, r"\byou (?:{A} )*{I}\b|\b(?:dear|hey|oi) (?:{A} )*{I}\b"),
    (3, r"\bwhat an? (?:{A} )+(?:little )?{I}\b|\bwhat an? (?:\w+ )?{I} (?:you are|are you)\b"),
    (3, r"\b(?:nobody|no one|noone|everyone|everybody|we all|we|i) (?:wants?|likes?|needs?|loves?|hates?|despises?|loathes?) (?:you\b|(?:an? )?(?:{A} )*{I} like you\b)"),
    (3, r"\bonly an? (?:{A} )*{I} (?:could|would|can) \w+\b"),
    (3, r"\b(?:mother|father|parents|family|kids|children) (?:must|should|ought to) be (?:so )?ashamed\b|\bashamed of such an? (?:{A} )*{I}\b"),
    (3, r"\b{YOU} {ARE}(?: \w+)? (?:dumber|stupider|uglier|thicker|fatter|dimmer|filthier|lazier|(?:more|less) \w+) than\b(?=.*)(?<!smarter than)|\b(?:dumber|stupider|thicker) than an? \w+ \w+\b"),
    (3, r"\b{YOU} (?:all )?makes? me (?:want to )?(?:puke|sick|vomit|retch|throw up)\b|\b(?:your (?:\w+ )?(?:face|voice|existence)) (?:makes|is|disgusts)\b"),
    (3, r"\b(?:{YOU} )?(?:\w+ )?waste of (?:air|space|oxygen|skin|breath)\b(?! (?:in|on|at|for|was)\b)"),
    # --- curses: somebody is told to hurt himself or to be gone
    (3, r"\b(?:go|just|please|do us a favou?r and|hurry up and)? ?(?:drown|choke|rot|burn|suffocate|perish|die|hang|bleed)(?: \w+)? (?:in|on|under|into|from|of) (?:your|ur|hell|them|it|yours)\b(?! (?:kitchen|kilns?|oven|pan|grill))"),
    (3, r"\bcrawl (?:back|off|away)(?: \w+)? (?:under|into|in|to) (?:your|ur|the|a|whatever) (?:\w+ )?\w+\b|\bcrawl back\b"),
    (3, r"\b(?:go )?(?:fuck|screw|sod|bugger|damn) (?:you|yourself|off|u)\b|\bpiss off\b|\bgo to hell\b|\brot in hell\b|\bdrop dead\b|\beat shit\b|\b(?:shove|stick) (?:it|them|that|your \w+) up (?:your|ur)\b|\bup yours\b|\bshut (?:the (?:fuck|hell) )?up\b.{0,20}{I}\b|\bshut the (?:fuck|hell) up\b|\bshut your (?:\w+ )?(?:mouth|face|trap|hole|gob)\b|\bkill yourself\b|\bgo (?:and )?(?:die|hang yourself|kill yourself|jump off)\b|\bkys\b"),
    (1.5, r"\bget lost\b|\bdelete your account\b"),
    # --- threats: a speaker or a wish, harm, and somebody addressed or what is theirs
    (3, r"\b(?:i|im|we|he|they|my \w+) (?:will|ll|going to|am going to|m going to|are going to|re going to|gonna|am gonna|m gonna|shall|would love to|d love to|want to|swear i ll|swear i will|promise to|have to|should|could)(?: \w+)? {H}(?: up| down| out| all)? (?:you|your|ur|u)\b(?! (?:an?|the|some|what|how|out|find|work|get|see|through|in touch|at)\b)(?<!find you)"),
    (3, r"\bnext time (?:i|we) (?:see|meet|find|catch) you\b.{0,60}\b(?:{H}|regret|sorry|dead|pay|bleed)\b|\b(?:i|we) (?:will|ll) (?:find|hunt|get|come for) you\b.{0,40}\b{H}\b"),
    (3, r"\b{YOU} (?:are|re) (?:a )?(?:dead|going to (?:die|bleed|pay for this|regret))(?: (?:man|woman|meat))?\b|\byour days are (?:numbered|over)\b|\byou (?:will|ll) (?:die|bleed|burn|suffer)\b(?! (?:from|of) )"),
    (3, r"\b(?:we|i) know (?:your (?:street|house|address|kids|school|car)|where (?:you|your \w+) (?:live|sleep|work|lives|sleeps|works|goes|go))\b"),
    (3, r"\b(?:hope|wish|pray)(?:ing)? (?:that )?(?:you|your \w+|you all|your whole \w+)(?: all| slowly| just)? (?:burns?|dies?|explodes?|rots?|chokes?|suffers?|drowns?|bleeds?|crash(?:es)?|gets? (?:hurt|cancer|killed|shot|hit|run over))\b"),
    (3, r"\b(?:people like you|{YOU}|your (?:kind|sort|lot|whole family)) {SHOULD} (?:be )?(?:all )?(?:\w+ )?(?:be )?(?:{P}|die|rot|burn|hang|suffer)\b|\b(?:somebody|someone|anyone) (?:should|ought to|needs to|has to|must) {H} (?:you|your)\b"),
    (2, r"\bsleep lightly\b|\bwatch your back\b|\bbefore (?:somebody|someone) makes you\b"),
    # --- the same in Polish
    (3, r"\budlaw sie\b|\bwypierdalaj\w*\b|\bspierdalaj\w*\b|\bodpierdol\w* sie\b|\bpierdol sie\b|\bjeb sie\b|\bjebac (?:cie|was)\b|\bwal sie\b|\bidz do diabla\b|\bnikt (?:cie|ciebie|was) (?:tu(?:taj)? )?nie (?:chce|lubi|potrzebuje|znosi)\b|\bwszyscy (?:cie|toba|ciebie) (?:\w+ )?(?:nienawidza|gardza)\b"),
    (3, r"\b(?:takich|ludzi|takie|takim) jak (?:ty|wy) (?:trzeba|powinno sie|nalezy|powinni)\b|\brzygac mi sie chce\b|\bniedobrze mi (?:od|na)\b|\bwracaj (?:pod|do) (?:\w+ )?(?:kamien|nory|dziury|jaskini)\b|\bzamknij (?:morde|ryj|pysk|jape|geb[ey]|sie)\b|\bstul (?:morde|pysk|ryj|dziob)\b|\b(?:obys|oby (?:cie|ci)|zebys) \w+\b(?! (?:zdrow|szczesl))|\bzdychaj\w*\b|\b(?:zabij|powies|utop) sie\b|\bzdechnij\b"),
    (3, r"\bwiemy gdzie (?:mieszkasz|spisz|pracujesz|mieszkacie)\b|\bwiem gdzie (?:mieszkasz|spisz|pracujesz)\b|\b(?:polamie|zabije|zatluke|dorwe|rozwale|spale|udusze|zamorduje|pobije|potne|zastrzele|polamiemy|zabijemy|dorwiemy|spalimy|udusimy) (?:ci|cie|was|wam|twoj\w+|ciebie)\b|\b(?:ci|cie|was) (?:\w+ )?(?:polamie|zabije|zatluke|dorwe|rozwale|spale|udusze|zamorduje|pobije|potne)\b|\bnastepnym razem\b.{0,40}\b(?:polamie|zabije|zatluke|dorwe|pobije|oberwiesz)\b|\boby (?:ci|twoj\w*) \w* ?(?:splon\w+|spalil\w*|zdech\w*)\b|\bjuz nie zyjesz\b|\bpozalujesz tego\b"),
    (3, r"\b(?:ty|wy|jestes|jestescie)(?: (?:taki\w*|zwykly\w*|zwyklym|tylko|po prostu|skonczonym|najwiekszym))? (?:{A} |{B} )*(?:{I}|idiota|debilem|kretynem|kretynka|palantem|dupkiem|smieciem|gnojem|pasozytem|tchorzem|zerem|nikim|dnem|smierdzielem|baranem|glupcem|idiotka|swinia|szmata|suka|burakiem|chamem|nieudacznikiem)\b"),
    (3, r"\b(?:{A} )+{I}\b(?<=[ouiey])"),
    (2.2, r"\b(?:idioto|debilu|kretynie|palancie|dupku|smieciu|gnoju|pasozycie|tchorzu|durniu|chuju|kutasie|skurwysynu|szmato|dziwko|kurwo|gnido|matole|frajerze)\b"),
    (3, r"\b(?:twoja matka|twoi rodzice|twoja rodzina) (?:musi|musza|powinn\w+) sie (?:za ciebie )?wstydzic\b|\btylko (?:{A} )*(?:idiota|debil|kretyn|palant|dupek|smiec|gnoj|pasozyt|glupek) (?:mogl\w*|moze)\b|\bjestes (?:glupszy|glupsza|brzydszy|brzydsza|tepszy|gorszy|gorsza) (?:niz|od)\b|\bnie jestes (?:nic )?wart\w*\b"),
    # --- in German
    (3, r"\b(?:verpiss|fick|verzieh|schleich|scher|trollt?|erhang|ertrank) (?:dich|euch)\b|\bhalt(?:et)? (?:endlich )?(?:die|deine|eure) (?:fresse|klappe|schnauze|maul)\b|\bhalts? maul\b|\bverreck\w*\b|\b(?:erstick|ersauf|ertrink|verfaul|verrott)\w*(?: doch)? (?:an|in|im) (?:dein\w*|der|eur\w*)\b|\bkriech(?:t)? zuruck\b|\b(?:du bist|ihr seid) (?:der|das) (?:aller)?letzte(?: dreck)?\b|\b(?:niemand|keiner) (?:will|mag|braucht) (?:dich|euch)\b|\b(?:alle|wir|ich) hassen? (?:dich|euch)\b|\bleck mich\b|\bgeh sterben\b|\b(?:bring|hang) dich (?:um|auf)\b|\bfahr zur holle\b|\bstirb (?:doch|endlich)?\b"),
    (3, r"\bleute wie (?:du|ihr) (?:gehoren|sollte\w*|verdienen|muss\w*)\b|\b(?:wir wissen|ich weiss) wo (?:du|ihr|deine \w+) (?:wohnst|schlafst|arbeitest|wohnt|schlaft|wohnen)\b|\b(?:ich|wir) (?:breche\w*|schlage\w*|bringe\w*|steche\w*|finde\w*|kriege\w*|hau\w*|toten?|erwurge\w*|zerstore\w*|vernichte\w*|verprugel\w*|erschiesse\w*|verbrenne\w*|werde\w*) (?:dir|dich|euch)(?: \w+)*? ?(?:um|zusammen|tot|tod|knochen|finger|beine|\w*schlagen|\w*bringen|toten|erwurgen|verprugeln|brechen|kaputt|fertig|ab|auf)\b|\bbreche? ich dir\b|\b(?:ich|wir) (?:tote|erwurge|vernichte|verprugle|verprugele|erschiesse|verbrenne) (?:dich|euch)\b|\bbeim nachsten mal\b.{0,40}\b(?:breche|schlage|finger|knochen|tot)\b|\bhoffentlich (?:brenn\w*|verreck\w*|stirbst|krepier\w*|erstick\w*)(?: (?:du|dein\w*|ihr|eu\w*))?\b|\bdein\w* (?:laden|haus|auto) (?:soll|sollte) (?:ab)?brennen\b|\bbevor einer nachhilft\b"),
    (3, r"\b(?:du|ihr|so ein|was fur ein|sie)(?: bist| seid)?(?: so)?(?: ein\w*| der| die| das| nur)?(?: \w+)? ?(?:{A} |{B} )*{I}\b|\bdu bist (?:so )?(?:dummer|hasslicher|blode?r|nutzloser|dummer) als\b|\bdein\w* (?:mutter|eltern|familie) (?:muss|mussen|sollte\w*) sich (?:fur dich )?schamen\b|\bmir wird (?:schlecht|ubel) wenn ich (?:dich|deine)\b|\bnur ein (?:{A} )*{I} (?:kann|konnte)\b"),
    # --- in Spanish
    (3, r"\bcallate (?:la|esa) (?:\w+ )?boca\b|\bcierra (?:el|ese) (?:pico|hocico)\b|\bojala (?:te|os|se) (?:\w+ )?(?:pudr\w+|muer\w+|ahog\w+|quem\w+|parta\w*|atropell\w+)\b|\b(?:te|os) (?:pudras|mueras)\b|\batragantate\b|\bahogate\b|\bpudrete\b|\bno (?:vales|valeis|sirves) (?:nada|para nada)\b|\bdas asco\b|\bvuelve (?:debajo|a tu) (?:de )?\w+\b|\bnadie te (?:quiere|soporta|aguanta|necesita)\b|\btodos te (?:odian|odiamos|desprecian)\b|\bvete a (?:la mierda|tomar por culo|cagar)\b|\bque te (?:jodan|den|follen)\b|\bjodete\b|\bmuerete\b|\b(?:matate|suicidate)\b|\bvete al (?:infierno|carajo)\b"),
    (3, r"\b(?:a )?(?:la )?gente como (?:tu|vosotros) (?:habria|hay|deberia\w*|merece\w*)\b|\b(?:sabemos|se) donde (?:vives|duermes|trabajas|vive tu \w+)\b|\b(?:te|os) (?:voy a|vamos a|quiero) (?:romper|matar|partir|pegar|reventar|quemar|estrangular|degollar|apunalar|disparar|hundir|machacar)\b|\bte (?:rompere|matare|partire|reventare|estrangulare|quemare|machacare)\b|\b(?:la )?proxima vez que te (?:vea|encuentre|pille)\b|\bojala (?:se )?(?:arda|queme|te queme\w*) tu\b|\bme das (?:asco|ganas de vomitar)\b|\bantes de que alguien te ayude\b|\bte vas a (?:arrepentir|morir|enterar)\b"),
    (3, r"\b(?:eres|sois|tu) (?:un |una |unos |unas |el |la |tan )?(?:\w+ )?(?:{A} |{B} )*{I}\b|\beres (?:un |una )?(?:\w+ )?{B}\b|\b(?:idiota|imbecil|payaso|parasito|cabron|gilipollas|cerdo|estupido|cretino) (?:{A}|de mierda)\b|\btu (?:madre|padre|familia) (?:debe|deberia|tiene que) (?:de )?(?:estar avergonzad\w+|avergonzarse)\b|\bsolo un (?:{A} )*{I} (?:{A} )?(?:podria|puede|escribe|escribiria)\b|\beres mas (?:tonto|tonta|feo|fea|inutil|estupid\w) que\b|\bmas tonto que\b"),
    # --- people degraded as a group: who they are said to be, what is to be done with them
    (3, r"\b{G} (?:are|is|were|will always be)(?: all| just| nothing but| like| no better than| worse than| less than| nothing more than| only| truly| really| simply)*(?: an?| the)?(?: \w+)? ?{D}\b(?! (?:are|is|were|of (?:that|the) (?:law|day)))"),
    (3, r"\b(?:are )?(?:thieves|criminals|liars|rapists|murderers|cheats) by (?:blood|birth|nature)\b|\bbreed(?:s|ing)? like (?:rats|rabbits|vermin|roaches|flies|cockroaches)\b|\b(?:less|worse|lower) than (?:animals|human|beasts|dogs|dirt)\b|\ba (?:disease|plague|cancer|stain|curse|blight) (?:on|to|of) (?:this|our|humanity|mankind|society)\b|\b{G} (?:are|is) an? (?:disease|plague|cancer|stain|curse|blight)\b|\bdo(?:es)?(?: not|n t) deserve (?:to (?:share|breathe|live)|our (?:air|land|bread))\b|\bstinks? and always will\b|\b{YOU} people are\b.{0,30}\b(?:{D}|{P})\b"),
    (3, r"\b{G} (?:all )?(?:do not |don t )?(?:belongs?|should|must|deserves?|needs?|ought|have|has)(?: all| to| only| never)*(?: be)?(?: \w+)? (?:{P}|behind (?:an? )?(?:fence|fences|bars|wire|wall)|in (?:an? )?(?:cages?|camps?|ovens?|crates?|zoos?|chains))\b|\b(?:should|must|needs? to|has to|have to) be (?:wiped out|exterminated|gassed|eradicated|put down)\b"),
    (3, r"\b(?:burn|torch|bomb|raid|smash) (?:down )?(?:the )?(?:houses|homes|shops|churches|mosques|synagogues|villages|quarters) of\b|\bno (?:street|town|city|country|village|shop|school|landlord) (?:should|must) (?:ever )?(?:let|allow|take|serve|accept)\b|\b(?:clean|safe|quiet|decent|better)(?: \w+)? (?:here )?(?:before|until) {G}(?: ever)? (?:crawled|came|arrived|moved|showed)\b|\b(?:shipped|sent|packed) (?:off|back|away|out) in (?:crates|boxes|cattle)\b|\bbelongs? behind (?:an? )?(?:fence|wire)\b|\b(?:send|ship|throw|kick|drive) {G} (?:back|out|home|away)\b"),
    (1.5, r"\bmust be driven out\b|\bkeep them (?:away|out)\b|\bevery single one\b|\bno matter what the papers say\b"),
    (3, r"\b(?:to|sa|jestescie)(?: \w+)? (?:{D}|gorsi od zwierzat)\b(?! (?:jest|sa|domow|hodow|lesn))|\b(?:mnoza|rozmnazaja) sie jak (?:szczury|kroliki|karaluchy|robactwo)\b|\bgorsi od zwierzat\b|\bzlodzieje z (?:krwi|urodzenia|natury)\b|\bzaraza tego\b|\bnie zasluguja na (?:nasze? )?(?:powietrze|ziemie|zycie|litosc)\b|\b(?:czysto|spokojnie|bezpiecznie) (?:tu )?bylo (?:tu )?zanim\b|\bsmierdza i zawsze beda\b|\b(?:trzeba|nalezy|powinno sie|musimy) (?:ich|je|tych \w+|wszystkich \w+) (?:\w+ )?(?:przegonic|spalic|wytepic|wywiezc|zamknac|wystrzelac|zabic|wyrzucic|powiesic|zgazowac|deportowac)\b"),
    (3, r"\b(?:podpalic|spalic|zburzyc) (?:domy|chaty|sklepy|meczety|synagogi)\b|\bmiejsce (?:jest )?za (?:plotem|drutem|kratami)\b|\bza (?:plotem|drutem)\b|\bwywiezc w (?:skrzyniach|wagonach)\b|\bzadna (?:ulica|wies|szkola) nie powinna\b|\bzadne miasto nie powinno\b|\bwon z (?:naszego|polski|naszej|kraju)\b"),
    (1.5, r"\btrzymac ich z daleka\b|\bbez wyjatku\b|\bpowtorze to jeszcze raz\b"),
    (3, r"\b{G} (?:sind|seid)(?: alle| nur| nichts als| wie| schlimmer als| weniger als| nichts anderes als| von geburt an)*(?: ein\w*| die| der)?(?: \w+)? ?{D}\b|\bsind (?:alle )?(?:\w+ )?(?:abschaum|untermenschen|schlimmer als tiere|weniger als tiere)\b|\b(?:von geburt an|geborene) (?:diebe|verbrecher|lugner)\b|\bdiebe von geburt\b|\bvermehren sich wie (?:ratten|karnickel|ungeziefer|die karnickel|kakerlaken)\b|\bverdienen (?:unsere luft|es) nicht\b|\bverdienen (?:kein|keine) (?:leben|gnade|mitleid)\b"),
    (3, r"\bgehoren (?:alle )?(?:\w+ )?(?:vertrieben|hinter (?:einen )?(?:zaun|gitter)|weggesperrt|verbrannt|erschossen|verladen|abgeschoben|verjagt|vergast|ausgerottet|eingesperrt|erschlagen)\b|\b(?:sauber|sicher|ruhig)(?: \w+)? bevor\b.{0,40}\b(?:kamen|angekrochen)\b|\bsauber bevor\b|\bangekrochen kamen\b|\bstinken und (?:werden )?(?:immer|es immer)\b|\bhauser (?:der|von)\b.{0,40}\b(?:anzunden|niederbrennen|verbrennen|abfackeln)\b|\b(?:anzunden|niederbrennen|abfackeln)\b.{0,30}\bhauser\b|\bkeine (?:strasse|stadt|schule) (?:sollte|darf)\b|\bin (?:kisten|viehwagen)\b.{0,25}\b(?:verschickt|verschiffen|verfrachtet|verschifft|abtransportiert)\b|\bseuche (?:an|auf|fur) diese\w*\b|\b(?:auslander|migranten|\w+ier) raus\b"),
    (1.5, r"\bhaltet sie fern\b|\bausnahmslos\b|\bgehoren vertrieben\b"),
    (3, r"\b{G} (?:son|sois)(?: todos| todas| solo| como| peores que| menos que| nada mas que)*(?: unas?| unos| la| una| los| las)?(?: \w+)? ?{D}\b|\bson (?:todos )?(?:unas? |unos )?(?:\w+ )?(?:alimanas|plaga|una peste|escoria|ratas|parasitos|infrahumanos|ladrones (?:de|por) (?:sangre|nacimiento)|peores que (?:los )?animales|menos que animales)\b|\bse (?:multiplican|reproducen) como (?:ratas|conejos|cucarachas)\b|\b(?:peores|menos) que (?:los )?animales\b|\bladrones (?:de|por) (?:sangre|nacimiento|naturaleza)\b|\bno merecen (?:respirar |vivir|nuestro aire|nuestra)\w*\b"),
    (3, r"\b(?:estaba|era) (?:\w+ )?(?:limpio|seguro|tranquilo) (?:aqui )?antes\b|\btodo (?:esto )?(?:estaba|era) limpio\b|\bapestan y siempre\b|\bhay que (?:echar|quemar|matar|encerrar|expulsar|exterminar|gasear|fusilar)(?:los|las| a (?:todos |todas )?(?:los |las )?\w+)\b|\bquemar (?:las )?(?:casas|tiendas|mezquitas|sinagogas)\b|\bdetras de (?:una valla|un muro|rejas)\b|\bninguna (?:calle|ciudad|escuela) (?:deberia|debe)\b|\ben cajas\b.{0,30}\b(?:enviarlos|mandarlos|embarcarlos)\b|\b(?:enviarlos|mandarlos|embarcarlos)\b.{0,20}\ben cajas\b|\benfermedad (?:de|en|para) est[ae] (?:costa|pais|ciudad|sociedad)\b|\bpeste de est[ae]\b|\bfuera (?:todos )?los \w{4,}\b(?= de)"),
    (1.5, r"\bque no se acerquen\b|\bsin excepcion\b|\bhay que echarlos\b"),
    # --- sexually explicit: acts and intimate parts of somebody
    (3, r"\b(?:tore|ripped|pulled|took|slid|pushed)(?: \w+)? (?:off |down |up )?(?:her|his|my|your) (?:\w+ )?(?:bra|panties|underwear|pants|dress|skirt|shirt|trousers|knickers|thong)\b.{0,80}\b(?:{V}|{N}|inside)\b|\b{V}(?: at| on| between)? (?:her|his|my|your) (?:\w+ )?{N}\b|\b(?:her|his|my|your) (?:\w+ )?{N} .{0,40}\b{V}\b|\bstraddled\b.{0,40}\bnaked\b|\bnaked and moan\w*\b"),
    (3, r"\b(?:slid|slides?|sliding|pushed|pushes|thrust|thrusts|thrusting|plunged|entered|enters|was|deep|deeper|hard)(?: \w+)? (?:inside|into|in|deeper into) (?:her|him|me|you)\b.{0,80}\b(?:{V}|{N}|gasp\w*|arch\w*|legs|hips|deeper|faster|harder)\b|\b(?:moan|gasp|arch|quiver|shudder|scream)\w*\b.{0,60}\b(?:inside her|inside him|inside me|between her (?:legs|thighs)|thrust\w*|climax\w*|orgasm\w*)\b|\bbetween (?:her|his|my) (?:legs|thighs)\b.{0,60}\b(?:{V}|tongue|wet|hard)\b|\b(?:tongue|mouth|lips|hand|fingers)\b.{0,40}\bbetween (?:her|his|my) (?:legs|thighs)\b"),
    (3, r"\b(?:panties|knickers) are (?:soaked|wet|off)\b|\b(?:your|my|his|her) (?:\w+ )?(?:cock|dick|pussy|cunt)\b.{0,12}\b(?:in|inside|into|on) (?:my|your|her|his)\b|\bsend (?:me )?(?:your )?nudes\b|\b(?:see|lick|eat|fuck|pound|want|suck|ride) (?:your|her|my|his) (?:\w+ )?(?:pussy|cunt|tits|ass|cock|dick)\b"),
    (3, r"\bhorny (?:\w+ )?(?:housewives|wives|women|girls|men|milfs|teens|moms|couples?|singles|\w+s)\b|\b(?:wants?|begs?|ready|dying) to (?:fuck|suck|be fucked)\b|\bin heat fucks?\b|\bfucks? on the\b|\bfucks? (?:her|him|them|me)\b|\bjerks? off\b|\b(?:beg|begs|begging) for (?:rough |hard |more )?(?:sex|cock|dick)\b|\brough sex\b|\bwet and willing\b|\bnaked (?:\w+ )?(?:amateurs?|girls|women|housewives|teens|wives|couples?|\w+s)\b.{0,30}\b(?:suck|ride|cam|live|fuck|show)\w*|\bsuck and ride\b|\bbusty (?:\w+ )?(?:show|women|girls|teens|\w+s)\b|\bshows? (?:their|her|me your|his) (?:tits|boobs|pussy|nipples|cock|dick)\b|\btits uncensored\b|\bstripped\b.{0,30}\bcame (?:twice|hard|again|inside|all over)\b|\bcame (?:twice|hard|inside her|all over)\b"),
    (3, r"\b(?:zdarl|sciagnal|zerwal) (?:z niej|z niego|jej|mu) (?:stanik|majtki|ubranie|sukienke)\b|\b(?:lizal|ssal|piescil|calowal)\w* (?:jej|jego|moje|twoje|mu) (?:\w+ )?{N}\b|\b(?:usiadla|siadla) na nim naga\b|\bnaga i jeczala\b|\bwszedl w nia\b|\bnagie (?:amatorki|fotki|laski|kobiety|dziewczyny)\b|\bmokre i chetne\b|\bnapalone? (?:\w+)\b|\bchc[ae] (?:sie )?(?:\w+ )?(?:pieprzyc|ruchac|bzykac)\b|\bostre? (?:filmy porno|porno|seks)\b|\bfilmy porno z\b|\b(?:twoja|jej|moja) (?:cipke|cipka|dupe)\b|\bchce (?:\w+ )?twojego (?:kutasa|penisa)\b|\btwoj(?:ego)? kutas\w* w (?:moich )?ustach\b|\bmajtki (?:sa|mam) (?:cale )?mokre\b|\bmokre majtki\b|\bzwala ci\b|\bwal\w* konia\b"),
    (3, r"\bgeile (?:\w+ )?(?:hausfrauen|frauen|weiber|ehefrauen|nachbarin|madchen|studentinnen|\w+en)\b|\bwoll(?:en|t) (?:\w+ )?ficken\b|\bfickt? (?:dich|mich|sie|ihn)\b(?! (?:selbst|doch))|\bnackte (?:amateur\w*|frauen|madchen|weiber)\b|\bfeuchte (?:frauen|\w*muschi)\b|\b(?:riss|zog|streifte) (?:ihr|ihm) (?:den|das|die) (?:bh|hoschen|kleid|hose)\b.{0,60}\b(?:{V}|{N}|vom leib)\b|\briss ihr den bh\b|\bleckte (?:ihre|seinen|meine) (?:\w+ )?{N}\b|\bnackt auf (?:ihn|sie)\b|\bdrang in sie ein\b|\bnacktbilder\b|\bdeine (?:\w+ )?(?:muschi|titten|fotze)\b|\b(?:deinen|seinen) schwanz\b|\bpornos? mit\b|\bscharfe pornos?\b|\bhoschen ist (?:ganz )?(?:nass|feucht)\b"),
    (3, r"\b(?:casadas|mujeres|chicas|vecinas|\w+as) cachondas\b|\bquieren follar\b|\bmujeres mojadas\b|\b(?:arranco|quito|bajo) (?:el sujetador|las bragas|la ropa|el vestido)\b.{0,60}\b(?:{V}|{N})\b|\barranco el sujetador\b|\b(?:lamio|chupo|acaricio)\w* (?:las |sus |los |la )?(?:\w+ )?{N}\b|\bsento desnuda\b|\bdesnuda encima\b|\bla penetro\b|\bfotos desnud\w+\b|\bverte el cono\b|\btu (?:cono|polla|culo) en\b|\bamateurs? desnud\w+\b|\bporno (?:duro|con|de)\b|\bquiero (?:tu|ver tu|chupar tu|comer tu) (?:polla|cono|culo)\b|\bbragas (?:estan )?(?:mojadas|empapadas)\b|\bfolla(?:n|ndo)? (?:en|con|sobre|hasta)\b"),
]
#: Two different sexual words in a clause count as much as one act; a single one does not.
_SEX_WEIGHT = 0.9

#: Context that lowers the score of a clause.
_CONTEXT: list[tuple[float, str]] = [
    (3, r"\b(?:report|study|article|guide|guidelines?|rules?|policy|moderation|handbook|paper|survey|court|judge|police|law|training|course|lesson|chapter|glossary|dictionary)\b.{0,60}\b(?:says?|said|heard|read|states?|quotes?|cites?|lists?|mentions?|condemns?|warns?|explains?|defines?|forbids?|bans?|prohibits?|describes?)\b"),
    (3, r"\b(?:the|a|this) (?:words?|terms?|phrase|slur|expression)\b|\bcalling (?:an? )?(?:\w+ )?(?:member|user|someone|somebody|people|anyone|person|colleague)s?\b|\b(?:leads?|led) to a (?:warning|ban)\b|\bcondemn(?:s|ed)? (?:it|them|this)\b|\bhate speech\b|\bquot(?:es|ed|ing)\b"),
    (3, r"\b(?:regulamin|raport|zasady|artykul|poradnik|badanie|sad|ustawa)\b.{0,60}\b(?:mowi|cytuje|podaje|opisuje|zabrania|potepia|wymienia|ostrzega)\b|\bslow[oa] \w+|\bnazwanie (?:kogos|czlonka)\b|\bmow[ay] nienawisci\b|\bpotepia\b|\bkonczy sie ostrzezeniem\b"),
    (3, r"\blaut (?:\w+ )?(?:regeln|bericht|richtlinie\w*)\b|\b(?:bericht|regeln|richtlinie\w*|artikel|studie|gericht)\b.{0,60}\b(?:zitiert|sagt|nennt|verbietet|verurteilt|warnt|erklart)\b|\b(?:das|ein) wort\b|\bhassrede\b|\bverwarnung\b|\bverurteilt es\b"),
    (3, r"\bsegun (?:las? )?(?:normas?|reglas?|informe|guia)\b|\b(?:informe|normas?|reglas?|articulo|estudio|guia)\b.{0,60}\b(?:cita|dice|menciona|condena|prohibe|advierte|explica)\b|\bla palabra\b|\bllamar \w+ a (?:un|una|otro|alguien)\b|\bacarrea un aviso\b|\bdiscurso de odio\b"),
    (2, r"\b(?:health|clinic|screening|medical|doctor|patient|hospital|therapy|anatomy|pollination|plant|education|courses?|surgery|nursing|biology|garden|feeder|birds?)\b|\b(?:zdrowi\w+|poradni\w*|lekarz\w*|klinik\w*|medyczn\w+|roslin\w*|edukac\w+)\b|\b(?:gesundheit|praxis|klinik|arzt|arztin|medizin\w*|pflanze\w*|vorsorge|kurs\w*)\b|\b(?:salud|clinica|medic[oa]s?|hospital|plantas?|educacion|curso\w*)\b"),
    (2, r"\b(?:file|valve|pump|cable|screw|process|crawler|server|port|plug|engine|bolt|hose|finish|cover|depot|tool|machine)\b|\b(?:pompa|zawor\w*|proces|kabel|robota|serwer\w*|silnik\w*|pilnik\w*)\b|\b(?:pumpe|ventil|prozess|kabel|schraube|feile|motor)\b|\b(?:bomba|valvula|proceso|tornillo|lima|motor)\b"),
]


#: The last two kinds of context excuse single words only, not acts, threats or insults that fit a pattern.
_TOPICS = 2


def _compiled(rules: list[tuple[float, str]]) -> list[tuple[float, re.Pattern]]:
    out = []
    for weight, p in rules:
        for key, alt in (("{I}", _INSULT), ("{A}", _ADJ), ("{B}", _BARE), ("{G}", _GROUP), ("{S}", _SEX), ("{H}", _HARM), ("{P}", _DONE), ("{D}", _LESS), ("{N}", _INTIMATE), ("{V}", _ACT), ("{YOU}", _YOU), ("{ARE}", _ARE), ("{SHOULD}", _SHOULD)):
            p = p.replace(key, alt)
        out.append((weight, re.compile(p)))
    return out


RULES, CONTEXT = _compiled(_RULES), _compiled(_CONTEXT)
_SEX_WORD = re.compile(r"\b" + _SEX + r"\b")


def _vocabulary() -> tuple[frozenset[str], frozenset[str]]:
    """Words of the patterns: all, and those that make a clause worth matching."""
    text = " ".join([*CLASSES.values(), *(p for _, p in _RULES)])
    words = set()
    for w in re.findall(r"[a-z]+(?:\?[a-z]*|\(\?:[a-z|]+\)\??)*", text.replace("\\b", " ").replace("\\w", " ")):
        for x in re.split(r"[^a-z]+", w):
            words.add(x)
    for w in re.findall(r"\b([a-z]+)([a-z])\?", text.replace("\\b", " ").replace("\\w", " ")):
        words.update((w[0], w[0] + w[1]))
    words = {w for w in words if len(w) > 1 or w in ("a", "u", "i", "w", "z", "y")}
    common = set(
        "a an the of in on to it is are re be you your u i we my me her his they them those these people all just such only will am can must should could would not no so one nobody like little on off for by with and that this at up out before after next time see know here"
        " ty ci cie sie jak to sa od ich na z za w jest nie tu i gdzie zanim raz jeszcze trzeba kobiety domy ludzie nasze wiary tej poludnia bez nic jestes co ze"
        " du die der das den dem ein eine einer ist sind bist dich dir wie von an als ihr ihre ihn auf mit in hinter bevor nicht wir wo ich sie es so nur leute frauen hauser aus suden"
        " our own than less night over work was crawl crates need under what twice behind opinion niz wybrzeza unsere und sich wenn verschickt nadie antes menos costa sin pod when there here water live take see new people way"
        " tu te la las el los un una de del en que no se son es por con mas hay como para a gente mujeres esta esa este fe sur le".split()
    )
    return frozenset(words), frozenset(w for w in words if w not in common and len(w) > 2)


VOCABULARY, TELLING = _vocabulary()
_SQUEEZED: dict[str, str] = {}
for _w in sorted(VOCABULARY):
    _SQUEEZED.setdefault(re.sub(r"(.)\1+", r"\1", _w), _w)

def _rules_of() -> dict[str, tuple[int, ...]]:
    """The rules that a telling word can take part in: a clause without such a word needs no matching."""
    out: dict[str, list[int]] = {}
    for i, (_, p) in enumerate(RULES):
        text = p.pattern.replace("\\b", " ").replace("\\w", " ")
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])\?", r"\1", text))) | set(re.findall(r"[a-z]+", re.sub(r"[a-z]\?", "", text)))
        stems = tuple(x for x in set(re.findall(r"([a-z]+)(?:\\w\*|\(\?:)", p.pattern.replace("\\b", " "))) if len(x) > 3)
        words |= {w for w in VOCABULARY if w.startswith(stems)} if stems else set()
        for w in words & TELLING:
            out.setdefault(w, []).append(i)
    for w in re.findall(r"[a-z]+", re.sub(r"\(\?:[^)]*\)\??", "", _SEX)) + [x for x in CLASSES["S"].split() if x.isalpha()]:
        out.setdefault(w, [])
    return {w: tuple(i) for w, i in out.items()}


_RULES_OF = _rules_of()
_RULE_WORDS = frozenset(_RULES_OF)

# --- transducer 1: spelling ----------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones (fixed values), and letters without a decomposition.
_LOOKALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "п": "n", "г": "r", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "ł": "l", "ø": "o", "đ": "d", "ı": "i", "ŧ": "t", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ſ": "s", "’": "'", "‘": "'", "ʼ": "'", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
})
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l", "(": "c"}
_TAG_INLINE = re.compile(r"</?(?:b|i|em|strong|u|s|span|font|a|mark|small|sup|sub|wbr)(?:\s[^<>]{0,200})?>", re.I)
_TAG = re.compile(r"<[!/?]?[a-z][^<>]{0,300}>", re.I)
_WIDTHLESS = re.compile("[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff\\u3164]")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_MARKS = re.compile("[\\u0300-\\u036f\\u0483-\\u0489\\u20d0-\\u20f0]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*~]{1,2}){2,}[^\W_](?![^\W_])(?:-(?=\W|$))?")
_TOKEN = re.compile(r"[^\W_]+(?:['*@$!|#%&^.\-_+€£]+[^\W_]+)*\*?")
_CLAUSE_END = re.compile(r"[.!?…;]+(?:\s|$)|\n+|(?<=[a-z]{3})[.?](?=[a-z]{3})")
_TRIPLE = re.compile(r"(.)\1\1")
_MASKS = re.compile(r"[*#%&^_.\-]+")


#: UTF-8 bytes that were read as a one-byte encoding.
_BROKEN = re.compile("(?:[\u00c2-\u00df][\u0080-\u00bf\u0152-\u017e\u0192\u02c6\u02dc\u2013-\u2122]|[\u00e0-\u00ef][\u0080-\u00bf\u0152-\u017e\u0192\u02c6\u02dc\u2013-\u2122]{2})")


def _mended(m: re.Match) -> str:
    raw = bytearray()
    for c in m.group(0):
        try:
            raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return m.group(0)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group(0)


def fold(text: str) -> str:
    """Lower case, without tags, entities, invisible characters, accents and look-alike letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _TAG_INLINE.sub("", text))
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _WIDTHLESS.sub("", _BROKEN.sub(_mended, text))).lower()
    plain = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return plain if plain.isascii() else _FOREIGN.sub(lambda m: m.group(0).translate(_LOOKALIKE), plain)


def _known(w: str) -> str | None:
    if w in VOCABULARY:
        return w
    if _TRIPLE.search(w):
        hit = _SQUEEZED.get(re.sub(r"(.)\1+", r"\1", w))
        if hit:
            return hit
        w1 = re.sub(r"(.)\1{2,}", r"\1", w)
        return w1 if w1 in VOCABULARY else None
    return None


@lru_cache(maxsize=200_000)
def _masked(w: str) -> str | None:
    """The word of the vocabulary that fits a word with masked letters, if there is one; the shortest fits best."""
    parts = [p for p in _MASKS.split(w)]
    if sum(map(len, parts)) < 2 or len(w) > 30:
        return None
    pattern = re.compile("[a-z]{0,3}".join(re.escape(p) for p in parts) + r"\Z")
    first = parts[0][:1]
    fits = [x for x in _BY_FIRST.get(first, VOCABULARY) if len(x) <= len(w) + 4 and len(x) >= len(w) - 3 and pattern.match(x)]
    telling = [x for x in fits if x in TELLING]
    return min(telling or fits, key=lambda x: (abs(len(x) - len(w)), x), default=None)


_BY_FIRST: dict[str, list[str]] = {}
for _w in sorted(VOCABULARY):
    _BY_FIRST.setdefault(_w[0], []).append(_w)


#: Cost of a letter that belongs to no known word, against 1 for a word.
_UNKNOWN = 0.9


def _segment(run: str, whole: bool = True) -> list[str]:
    """Words of a run of joined letters: the fewest words of the vocabulary that cover it, else the run itself. Unless
    ``whole``, letters may stay that no word covers."""
    if run in VOCABULARY:
        return [run]
    best: list[tuple[float, int, bool] | None] = [(0.0, 0, True)] + [None] * len(run)  # cost up to here, start of the last, known
    for i in range(1, len(run) + 1):
        for j in range(max(0, i - 16), i):
            if best[j] is not None and run[j:i] in VOCABULARY and (best[i] is None or best[j][0] + 1 < best[i][0]):
                best[i] = (best[j][0] + 1, j, True)
        if not whole and (best[i] is None or best[i - 1][0] + _UNKNOWN < best[i][0]):
            best[i] = (best[i - 1][0] + _UNKNOWN, i - 1, False)
    if best[-1] is None:
        return [run]
    words, i, loose = [], len(run), ""
    while i:
        _, j, known = best[i]
        if known:
            words += [loose, run[j:i]] if loose else [run[j:i]]
            loose = ""
        else:
            loose = run[j:i] + loose
        i = j
    return ([*words, loose] if loose else words)[::-1]


@lru_cache(maxsize=400_000)
def spell(token: str) -> str:
    """A folded token in plain spelling."""
    if token.isalpha():
        hit = _known(token)
        if not hit and "v" in token:
            hit = _known(token.replace("v", "u"))
        if not hit and len(token) >= 11:
            hit = " ".join(_segment(token))
        return hit or token
    if not any(c.isalpha() for c in token):
        return token
    t = token.strip("'-_.+&%#^|")
    if "*" in t or "#" in t:
        hit = _masked(t)
        if hit:
            return hit
    plain = "".join(_LEET.get(c, c) for c in t)
    for cand in (plain, plain.replace("i", "l") if "1" in t or "!" in t else plain, "".join({"1": "l"}.get(c, _LEET.get(c, c)) for c in t), re.sub(r"v", "u", plain)):
        joined = re.sub(r"[^a-z]", "", cand)
        hit = _known(cand) or _known(joined)
        if hit:
            return hit
    if "'" in t:
        return t.replace("'", " ")
    pieces = [p for p in re.split(r"[^a-z0-9]+", plain) if p]
    return " ".join(_known(p) or p for p in pieces) if pieces else t


class _Spelled(dict):
    """Plain spelling of tokens, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        self[token] = w = spell(token)
        return w


_SPELLED = _Spelled()


def clauses(text: str) -> Iterator[str]:
    """Transducers 1 and 2: the clauses of a text as plain words."""
    s = fold(text)

    def join(m: re.Match) -> str:
        run = re.sub(r"[^\w]|_", "", m.group(0))
        run = "".join(_LEET.get(c, c) for c in run)
        return " " + " ".join(_segment(run, whole=False)) + " " if run.isalpha() else m.group(0)

    for part in _CLAUSE_END.split(_SPACED.sub(join, s)):
        if len(part) > 3:
            yield " ".join(map(_SPELLED.__getitem__, _TOKEN.findall(part)))


# --- transducers 3 to 5: patterns, negation and context ---------------------------------------------------------------------


#: Characters around a match in which reported speech excuses it.
_BEFORE, _AFTER = 90, 60


#: A denial right before a pattern that begins with its predicate, or between the copula and the predicate inside one.
#: "not only" denies nothing.
_DENIED_BEFORE = re.compile(r"\b(?:not|never|neither|(?:are|is|was|were|do|does|did)n? t|nie|nicht|kein\w*|weder|no|nunca|jamas|tampoco)(?: (?:an?|the|all|really|any|eine?|unos?|unas?|todos))* $")
_DENIED_INSIDE = re.compile(r"\b(?:are|is|re|sind|ist|bist|seid|son|es|eres|sois|sa|to|jest|jestes|jestescie)(?: all| alle| todos)? (?:not|never|no|nie|nicht|kein\w*|nunca)\b(?! (?:only|just|merely|nur|tylko|solo))")
_ADDRESSED = re.compile(r"(?:you|u|ya|ty|du|ihr|tu|i|what|nobody|go|people)\b")


def denied(clause: str, start: int, end: int) -> bool:
    """Whether the pattern that was met there is denied."""
    if _DENIED_INSIDE.search(clause, start, end):
        return True
    return _ADDRESSED.match(clause, start) is None and _DENIED_BEFORE.search(clause[max(0, start - 40) : start]) is not None


def clause_score(clause: str) -> float:
    met = _RULE_WORDS.intersection(clause.split())
    ids = {i for w in met for i in _RULES_OF[w]}
    if not ids:
        return 0.0
    score = 0.0
    for i in sorted(ids):
        weight, p = RULES[i]
        best = 0.0
        for m in p.finditer(clause):
            if denied(clause, m.start(), m.end()):
                continue
            near = clause[max(0, m.start() - _BEFORE) : m.end() + _AFTER]
            best = max(best, weight - sum(w for w, c in CONTEXT[:-_TOPICS] if c.search(near)))
            if best == weight:
                break
        score += best
    sexual = set(_SEX_WORD.findall(clause))
    if sexual:
        hint = _SEX_WEIGHT * min(len(sexual), 4) if len(sexual) > 1 or score else 0.5
        score += max(0.0, hint - sum(w for w, c in CONTEXT if c.search(clause)))
    return score


def text_score(text: str | None) -> float:
    if not text or text.isspace():
        return 0.0
    scores = [x for x in map(clause_score, clauses(text)) if x]
    if not scores:
        return 0.0
    top = max(scores)
    return min(10.0, top + REST * min(sum(scores) - top, 10.0)) if top >= THRESHOLD else min(top, THRESHOLD - 0.01)


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``score`` (0 to 10) of every row."""
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = np.fromiter((text_score(t) for t in b.column(len(cols)).to_pylist()), dtype=np.float64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(s)], names=[*cols, "score"])

    return spread(df.select(*cols, text_col)).mapInArrow(run, f"{kinds}, score double")


def rates(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, channel, documents, cases, rate``: one row for each known source and one for documents without."""
    by = scores.groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("score") >= THRESHOLD, 1)).alias("cases"))
    known = sources.groupBy("source").agg(F.min("channel").alias("channel"))
    return (
        known.join(by, known["source"].eqNullSafe(by["source"]), "full")
        .select(F.coalesce(known["source"], by["source"]).alias("source"), "channel", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("cases", F.lit(0)).alias("cases"))
        .withColumn("rate", F.when(F.col("documents") > 0, F.col("cases") / F.col("documents")))
    )
