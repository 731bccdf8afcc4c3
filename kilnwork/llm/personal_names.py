"""Names of private persons in free text, told by what stands around them: titles, naming phrases, roles, verbs of people, known given names.

A cue word is found by one pass of an automaton over the text, and patterns match from there; nothing limits how far a match may
reach, so what is found doesn't depend on where in a text it stands. Strengths of cues: behind `NAMING` phrases a name of any
spelling follows; behind `STRONG` ones and `ROLES` a capitalised word is a name; behind `WEAK` ones and before `VERBS` only two of
them, given and family name, are. Without a cue two capitalised words within a sentence are taken, unless what stands before them
points to a place, dish or thing (`_THINGS`).
"""

from __future__ import annotations

import re
from collections import defaultdict

S = r"[ \t\xa0]"  # a blank within a line
_U = "A-ZÀ-ÖØ-ÞĀ-Ž"
_L = "a-zß-öø-ÿĀ-ž"
_WORD = rf"(?:(?:Mc|Mac|O['’]|D['’]|al-)?[{_U}][{_L}]+|(?:MC|O['’]|D['’]|AL-)?[{_U}]{{2,}})"
_HYPHEN = rf"{_WORD}(?:-(?:{_WORD}|[{_L}]{{2,5}}(?![{_L}])))*"
_PARTICLE = rf"(?:(?:de|van|von|der|den|da|di|del|la|le|al|bin|dos|ten|zu|DE|VAN|VON|AL){S}+)*"
_INITIAL = rf"[{_U}]\."
#: Given name, with initials, particles and family names; or a family name, a comma and a given name.
NAME = (
    rf"(?:{_PARTICLE}{_HYPHEN},{S}+{_HYPHEN}(?![\w'’\-])|{_INITIAL}{S}*(?:{_INITIAL}{S}*)?{_PARTICLE}{_HYPHEN}|{_HYPHEN}(?:{S}+{_INITIAL}(?=\W|$))?(?:{S}+{_PARTICLE}{_HYPHEN}(?:{S}+{_PARTICLE}{_HYPHEN}(?={S}*(?:[,.;:<&!)/\r\n]|$)))?)?|{_INITIAL}{S}?{_INITIAL})"
)
_NAME_AT = re.compile(NAME)
_NAME_END = re.compile(rf"(?<![\w'’\-@.])(?:{_PARTICLE}{_HYPHEN},{S}+{_HYPHEN}|{_INITIAL}{S}*(?:{_INITIAL}{S}*)?{_PARTICLE}{_HYPHEN}|{_HYPHEN}(?:{S}+(?:{_INITIAL}|{_PARTICLE}{_HYPHEN})){{0,3}}){S}+\Z")
_LOWER_WORD = r"[a-zß-öø-ÿ][a-zß-öø-ÿ'’\-]+"
_LOWER_AT = re.compile(rf"{_LOWER_WORD}(?:{S}+{_LOWER_WORD}){{0,3}}")
_LOWER_END = re.compile(rf"(?:^|[\n\r,;:.!?(>\-]{S}*|{S}(?:and|y|et|und|&){S}+)(?P<name>{_LOWER_WORD}{S}+{_LOWER_WORD}){S}+\Z")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Srta|Herr|Herrn|Frau|Mme|Mlle|Don|Doña|Monsieur|Madame|Señor|Señora)"
_TITLES = re.compile(rf"(?i:{_TITLE})\b\.?{S}+(?:(?i:and|und|y|et|&){S}+(?i:{_TITLE})\b\.?{S}+)?")
_GAP = re.compile(rf"{S}*[:=,]?{S}*[\"'“„«(]?{S}*")
_BLANKS, _ROLE_GAP, _PARTICLES_END = re.compile(rf"{S}+"), re.compile(rf"{S}*\({S}*|{S}*[,:]?{S}+"), re.compile(rf"(?<!\w){_PARTICLE}\Z")
_WORDS = re.compile(r"[^\s,]+")
_LAST_WORD = re.compile(r"[\w'’.\-]+\Z")
_SHOUTED = re.compile(rf"[,]?{S}+[{_U}]{{2,}}(?![{_L}])")
_SMALL_PARTICLES = frozenset("de van von der den da di del la le al bin dos ten zu".split())
_NEW_LINE = re.compile(rf"{S}*[,.!]?{S}*(?:(?:\r?\n|<br{S}*/?>)(?:{S}|>)*)+")

#: Phrases behind which a name stands, in whatever spelling.
NAMING = """name is|name of|name's|names are|named|name|nombre es|nombre de|nombre|nom est|nom de|nom|name ist|namens|namen|reservation under|booking under|booked under|table under|
    booked by|reserved by|signed by|signed|written by|addressed to|adressée à|adressé à|dirigida a|dirigido a|adressiert an|belongs to|belong to|holder|cardholder|titular|titulaire|inhaber|guest|guest"|
    llamo|llama|appelle|heiße|heisse|heißt|tisch auf|firmado|signé|unterzeichnet|attn|c/o|atención de|attention de|händen von|reservado por|réservé par|gebucht von|reserviert von"""
#: Phrases behind which a capitalised word is a name.
STRONG = """told|ask for|asked for|asking for|speak to|speak with|spoke to|spoke with|talk to|talked to|talked with|met with|thanks to|thank you to|thank|kudos to|props to|credit to|
    delivery for|reservation for|booking for|parcel for|package for|letter for|letter to|message for|order for|invoice to|dear|emailed|texted|
    gracias a|pregunte por|pregunten por|preguntar por|hablé con|hablar con|hablamos con|conocí a|llamé a|entrega para|reserva para|carta para|estimado|estimada|querido|querida|
    merci à|demandez|demander|parlé à|parlé avec|parler à|discuté avec|rencontré|livraison pour|réservation pour|lettre pour|cher|chère|
    danke an|dank an|fragen sie nach|fragt nach|fragte nach|gesprochen mit|sprach mit|sprechen mit|geredet mit|traf|lieferung an|lieferung für|brief an|geehrter|geehrte|lieber|liebe"""
#: People by what they do or are to the writer; a name may follow, also behind a comma.
ROLES = """server|waiter|waitress|chef|cook|manager|host|hostess|owner|bartender|barista|cashier|clerk|receptionist|supervisor|sommelier|driver|friend|husband|wife|brother|sister|son|
    daughter|mother|father|uncle|aunt|cousin|boss|colleague|coworker|neighbour|neighbor|nephew|niece|grandmother|grandfather|grandma|grandpa|roommate|flatmate|landlord|teacher|doctor|lawyer|nurse|partner|customer|client|patient|
    camarero|camarera|mesero|mesera|cocinero|cocinera|gerente|dueño|dueña|encargado|encargada|amigo|amiga|marido|esposo|esposa|hermano|hermana|hijo|hija|vecino|vecina|compañero|compañera|tío|tía|abuelo|abuela|primo|prima|suegro|suegra|nuera|yerno|cuñado|cuñada|
    jefe|jefa|recepcionista|serveur|serveuse|gérant|gérante|patron|patronne|cuisinier|cuisinière|propriétaire|hôtesse|ami|amie|mari|frère|soeur|sœur|voisin|voisine|collègue|oncle|tante|grand-mère|grand-père|cousine|neveu|nièce|mère|père|
    kellner|kellnerin|koch|köchin|chefin|küchenchef|küchenchefin|besitzer|besitzerin|wirt|wirtin|bedienung|freund|freundin|bruder|schwester|sohn|tochter|nachbar|nachbarin|kollege|kollegin|onkel|oma|opa|mutter|vater|neffe|nichte|cousin|cousine|
    geschäftsführer|geschäftsführerin|inhaber|inhaberin|titular|titulaire|rencontré"""
#: Phrases behind which only a given with a family name is taken.
WEAK = """i am|i'm|i’m|this is|met|meet|saw|know|reach|contact|contacted|thanked|invited|visited|hired|helped by|served by|greeted by|seated by|let|tell|remind|hello to|regards to|hi to|forward this to|forward it to|forward to|gave it to|according to|write to|wrote to|written to|reply to|replied to|hi|hello|hey|soy|hola|vi a|felicitar a|felicito a|avisar a|escribí a|escribir a|escribe a|dile a|pagué a|según|je suis|bonjour|écrit à|écrire à|écrivez à|dit à|dire à|selon|félicitations à|ich bin|hallo|rief|laut|schrieb an|schreiben an|grüße an|gruß an"""
CLOSING = """best|abrazos|abrazo|bises|lg|vg|regards|sincerely|cheers|best wishes|yours|atentamente|saludos|saludo|cordialement|amicalement|grüßen|grüße|gruß"""
#: What people do, behind their name. French perfects have their auxiliary before them.
VERBS = """said|says|told|asked|called|complained|promised|split|answered|never answered|replied|explained|apologised|apologized|recommended|suggested|greeted|welcomed|served|helped|brought|took|left|
    wrote|emailed|phoned|texted|refused|insisted|agreed|thanked|smiled|laughed|shouted|cooked|paid|ordered|booked|confirmed|forgot|offered|noticed|waited|arrived|works|lives|kindly|
    dijo|dice|llamó|preguntó|prometió|respondió|contestó|atendió|nos atendió|sirvió|ayudó|recomendó|explicó|vino|trajo|pagó|escribió|vive|trabaja|se quejó|reservó|pidió|cocinó|olvidó|
    a dit|a appelé|a promis|a répondu|a servi|nous a|m'a|m’a|a aidé|a expliqué|a recommandé|a apporté|a payé|a écrit|a réservé|a demandé|s'est plaint|s’est plaint|travaille|habite|est venu|est venue|
    sagte|sagt|rief|versprach|antwortete|fragte|erklärte|empfahl|brachte|half|bediente|kam|zahlte|bezahlte|schrieb|wohnt|arbeitet|beschwerte|bestellte|reservierte|kochte|vergaß|begrüßte|hat|gesprochen|geredet|telefoniert|beschwert|getroffen"""
_AND = re.compile(rf"{S}+(?:and|AND|y|et|und|&){S}+\Z")

#: Capitalised or small words that are no one's name: of English, Spanish, French and German.
_NO = [
    """the a an this that these those my our your his her their its it i you he she we they who whom whose what when where why how which sir madam customer customers guest guests team all everyone
    everybody everything friend friends manager management chef host server staff duty kitchen menu order orders table tables unit flat street road lane avenue not no mr mrs ms dr miss and or of in on at to for from by with
    without only as is are was were be been being am do does did done has have had will would can could should may might must just so but if then than too very really also again once twice there here now""",
    """yesterday today tonight tomorrow later sometimes usually finally honestly unfortunately sadly luckily however although though because since until while after before during last next first second
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december lunch dinner brunch breakfast noon midnight morning
    evening afternoon night day week month year closing phone tel email id nobody somebody someone anyone each every more most less us me him them call owner waiter waitress service food
    place restaurant coffee tea soup salad pizza burger sauce wine beer dessert bread rice chicken fish great good best worst bad nice lovely amazing wonderful friendly rude slow quick fast fresh cold hot warm""",
    """clean dirty cheap expensive tasty delicious awful terrible perfect excellent fantastic special happy new old big small little extra free whole same other another some any many few both two three
    four five six seven eight nine ten people person kids children family mother father brother sister wife husband boss neighbor neighbour help refund details directions information questions reviews reservation booking
    delivery invoice receipt voucher gift card discount bill check tip window bar patio terrace thanks thank please hello hi hey dear regards sincerely cheers yours best""",
    """el la los las un una unos unas de del al y o que en con por para sin su sus mi mis tu nuestro nuestra lo le les se me nos es son era fue está están muy más menos pero como si no también ya todo
    toda todos todas equipo cliente clientes señor señora lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
    ayer hoy mañana noche tarde día comida cena mesa cocina camarero camarera servicio personal gracias hola estimado amigo amigos gerente encargado favor pedido reserva cuenta buena bueno mejor""",
    """le la les un une des du de d l au aux et ou que qui en dans sur avec sans pour par son sa ses mon ma mes notre nos votre vos leur ce cet cette ces il elle on nous vous ils elles est sont était
    été très plus moins mais comme si ne pas aussi tout toute tous toutes équipe client clients monsieur madame lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril mai juin juillet août
    septembre octobre novembre décembre hier demain soir matin midi jour repas dîner déjeuner table cuisine serveur serveuse service personnel merci bonjour cher chère addition commande bon bonne accueil""",
    """der die das den dem des ein eine einen einem einer und oder dass in im an am auf aus bei mit nach von vom zu zum zur für ohne um über unter sein seine ihr ihre mein meine unser unsere euer es er sie wir
    ihr ich du man ist sind war waren wird sehr mehr weniger aber wie wenn nicht auch alle alles team kunde kunden herr frau montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz
    april mai juni juli august september oktober november dezember gestern heute morgen abend mittag tag essen küche tisch kellner kellnerin bedienung service personal danke hallo liebe lieber gast gäste
    rechnung bestellung gut gute guten beste restaurant leider damen herren grüßen gruß""",
]
NO_NAME = frozenset(" ".join(_NO).split())
_BUSINESS = re.compile(rf"(?:['’]s|{S}+(?:&|and){S}+(?:Sons|Co|Daughters)|{S}+(?:[^\W\d_][\w'’\-]*{S}+)?(?:House|Grill|Bakery|Deli|Tavern|Diner|Kitchen|Cafe|Café|Bar|Shop|Inn|Bistro|Restaurant|Street|Road|Avenue))\b", re.I)


def _of_business(text: str, end: int) -> bool:
    """Whether what ends here goes on as the name of a business or street: a possessive or a noun of them, not in small letters."""
    m = _BUSINESS.match(text, end)
    return m is not None and (m[0][0] in "'’" or not m[0].split()[-1][0].islower())


_END_OF_LOWER = re.compile(rf"{S}*(?:[,;:&\"/<(!)]|\.(?:\W|$)|\r?\n|$)|{S}+\d")


def _phrases(text: str) -> list[str]:
    return [" ".join(p.split()) for p in text.split("|") if p.strip()]


def _by_first_word(groups: dict[str, str]) -> dict[str, list[tuple[str, re.Pattern]]]:
    """First word -> (strength, pattern of the phrases that start with it), longer phrases first."""
    by: dict[tuple[str, str], list[str]] = defaultdict(list)
    for strength, text in groups.items():
        for p in _phrases(text):
            by[p.split()[0], strength].append(p)
    out: dict[str, list] = defaultdict(list)
    for (first, strength), some in by.items():
        some.sort(key=len, reverse=True)
        out[first].append((strength, re.compile(rf"(?:{'|'.join(rf'{S}+'.join(map(re.escape, p.split())) for p in some)})(?![\w'’])", re.I)))
    return dict(out)


_LEFT = _by_first_word({"naming": NAMING, "strong": STRONG, "role": ROLES, "weak": WEAK, "closing": CLOSING})
_RIGHT = _by_first_word({"verb": VERBS})
#: Verbs of which only a person is the subject: a known given name alone may stand before them.
_ALONE = re.compile(
    r"(?:said|says|told|asked|called|complained|promised|split|answered|never answered|replied|explained|apologi[sz]ed|recommended|suggested|emailed|phoned|texted|refused|insisted|agreed|thanked|smiled|laughed"
    r"|dijo|dice|llamó|preguntó|prometió|respondió|contestó|a dit|a appelé|a promis|a répondu|sagte|sagt|rief|versprach|antwortete|fragte|erklärte)\b",
    re.I,
)
#: Nouns behind which a name only stands after a sign.
_BARE = frozenset(("name", "nom", "nombre", "namen"))
#: Given names that are small words, too: names if another word of the name follows.
_BOTH = frozenset("may will april june august".split())
#: Salutations, which are other words where they start small.
_SALUTATIONS = frozenset("cher chère dear liebe lieber querido querida estimado estimada".split())
_SIGNED = re.compile(r"signed|firmado|signé|unterzeichnet", re.I)
_CALLED = re.compile(rf"called{S}+from\b|rief{S}+an\b|llamó{S}+desde\b|a{S}+appelé{S}+de\b", re.I)


#: Small words behind which two capitalised words are a place, a dish or a thing rather than a person: articles, possessives, places, eating.
_THINGS = frozenset(
    """the a an this that these those our my your his her their its no any some each every in at from near to into around by on under over of with and or for as than like via per past through toward
    visit visited visiting ate eat eating order ordered ordering had have has try tried trying drank drink drinking love loved loves like liked likes serve serves served serving taste tasted tastes recommend watch watched
    called named between before after since until during without about against plus versus vs is was are were be
    el la los las un una unos unas mi tu su nuestro nuestra en de del al a con por para y o sin desde hasta entre sobre es son era fue probé probamos comí comimos pedí pedimos
    le les une des du au aux mon ma mes ton ta son sa ses notre nos votre leur dans sur avec sans pour par et ou chez vers est était sont bu mangé pris goûté
    der die das den dem des ein eine einen einem einer mein meine dein sein seine ihr ihre unser unsere im am ans ins beim vom zum zur auf aus bei mit nach von zu um für ohne und oder wie als ist war sind waren gibt gab aß nahm trank""".split()
)
_LAST_OF_THINGS = frozenset("house grill bakery deli tavern diner kitchen cafe café bar shop inn bistro restaurant hotel street st road rd avenue ave lane ln drive dr court ct way blvd place square park bay falls city lake".split())
_PLAIN = re.compile(rf"(?<![\w'’\-@./&]){_HYPHEN}{S}{_PARTICLE}{_HYPHEN}(?![\w'’\-]|{S}+[{_U}0-9]|{S}*&)")
_TITLE_WORDS = [w.lower() for w in re.findall(r"[^\W\d_]+", _TITLE.split("(?:")[1])]


class Names:
    """Finds names; given and family: known names, as they are written."""

    def __init__(self, given: list[str], family: list[str], others: dict[str, str] | None = None) -> None:
        """others: further words that the automaton looks for, with a kind of one sign each."""
        import ahocorasick

        self.given = frozenset(g.lower() for g in given)
        self.known_words = self.given | {f.lower() for f in family}
        forms = {f for g in given for f in (g, g.upper())}
        self.forms = forms
        one = f"(?:{'|'.join(map(re.escape, sorted(forms, key=lambda g: (-len(g), g))))})" if forms else r"(?!)"
        self.known = re.compile(rf"{one}(?:-{_WORD})*(?:(?:{S}+{_INITIAL})?{S}+{_PARTICLE}{_HYPHEN}(?!\w)|{S}+{_INITIAL}(?=\W|$))")
        self.known_last = re.compile(rf"{one}(?:-{_WORD})*(?![\w'’\-])")
        kinds: dict[str, set[str]] = defaultdict(set)
        for w, kind in (others or {}).items():
            kinds[w].add(kind)
        for words, kind in ((_LEFT, "l"), (_RIGHT, "r"), (_TITLE_WORDS, "t"), (["--"], "d"), ([g.lower() for g in given], "g")):
            for w in words:
                kinds[w].add(kind)
        self.automaton = ahocorasick.Automaton()
        for w, kind in kinds.items():
            self.automaton.add_word(w, ("".join(sorted(kind)), len(w)))
        self.automaton.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int, str]]:
        """start, end, kinds of every word looked for in a text in small letters."""
        return [(end - length + 1, end + 1, kinds) for end, (kinds, length) in self.automaton.iter(low)]

    def find(self, text: str, low: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """Spans of names, the better told first. low: the text in small letters, of the same length."""
        best: list[list[tuple[int, int]]] = [[], [], []]
        size = len(low)
        for at, end, kinds in hits:
            if "d" in kinds:
                if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "-"):
                    m = _BLANKS.match(text, end)
                    if m:
                        self._behind(text, at, m.end(), "naming", best)
                continue
            if at and (low[at - 1].isalnum() or low[at - 1] == "_" or low[at - 1] in "'’-" and at > 1 and low[at - 2].isalnum() and not ("g" in kinds or "l" in kinds and low[at - 1] != "-")):
                continue
            if end < size and (low[end].isalnum() or low[end] == "_"):
                continue
            word = low[at:end]
            if "t" in kinds:
                m = _TITLES.match(text, at)
                if m:
                    self._behind(text, at, m.end(), "naming", best)
            if "l" in kinds:
                for strength, pattern in _LEFT[word]:
                    m = pattern.match(text, at)
                    if m and not (word in _SALUTATIONS and text[at].islower()):
                        self._cue(text, at, m.end(), strength, best)
            if "r" in kinds and at > 1:
                for _, pattern in _RIGHT[word]:
                    m = pattern.match(text, at)
                    if m and text[at - 1] in " \t ":
                        self._before(text, at, best)
            if "g" in kinds and text[at].isupper():
                self._known(text, at, best)
        for m in _PLAIN.finditer(text):
            at = m.start()
            if at < 2 or text[at - 1] not in " \t\xa0" or not text[at - 2].isalpha() or m[0].isupper():
                continue
            start = at - 1
            while start and text[start - 1].isalpha():
                start -= 1
            before = text[start : at - 1]
            if before.islower() and before not in _THINGS and not any(w.lower() in NO_NAME for w in re.findall(r"[^\W\d_]+", m[0])) and m[0].split()[-1].lower() not in _LAST_OF_THINGS and not _of_business(text, m.end()):
                best[2].append(m.span())
        return [span for spans in best for span in spans]

    def _cue(self, text: str, at: int, end: int, strength: str, best: list) -> None:
        if strength == "closing":
            m = _NEW_LINE.match(text, end)
            if m:
                self._behind(text, at, m.end(), "naming", best)
            return
        if strength == "role":
            m = _ROLE_GAP.match(text, end)
        else:
            m = _GAP.match(text, end)
        if m and m.end() > end:
            if strength == "role" and "," in m[0]:
                strength = "weak"
            elif strength == "role" and "(" in m[0]:
                strength = "strong"
            if strength == "naming" and text[at:end].lower() in _BARE and not any(c in "\"'“„«:=" for c in m[0]):
                strength = "weak"
            elif "," in m[0] and strength in ("naming", "strong") and not _SIGNED.match(text, at):
                strength = "weak"
            self._behind(text, at, m.end(), strength, best)

    def _behind(self, text: str, cue: int, start: int, strength: str, best: list) -> None:
        """A name that starts at `start`, behind a cue from `cue` on."""
        title = _TITLES.match(text, start)
        if title:
            start, strength = title.end(), "naming"
        m = _NAME_AT.match(text, start)
        if m and not (m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_")):
            around = text[cue:start]
            shouted = m[0].isupper() and sum(map(str.isalpha, around)) > 3 and around.isupper()
            shouted = shouted or m[0].isupper() and strength == "weak" and _SHOUTED.match(text, m.end()) is not None
            if shouted and not any(w in self.given for w in re.split(r"[\s,\-]+", m[0].lower())):
                return
            span = self._trimmed(text, start, m.end())
            if span and (strength != "weak" or self._two_parts(text[slice(*span)])):
                best[1 if strength == "weak" else 0].append(span)
            return
        if strength == "weak":
            return
        m = _LOWER_AT.match(text, start)
        if not m:
            return
        words, end = [], start
        for w in re.finditer(_LOWER_WORD, m[0]):
            bare = w[0][2:] if w[0][1:2] in ("'", "’") else w[0]
            if (bare in NO_NAME or w[0] in _VERB_WORDS) and not (w[0] in self.known_words and (words or w[0] in self.given) or not words and w[0] in _BOTH) or len(words) == 3:
                break
            if len(words) == 2 and words[1] not in _SMALL_PARTICLES:
                break
            words.append(w[0])
            end = start + w.end()
        if not words or end < len(text) and (text[end].isalnum() or text[end] in "_@"):
            return
        parts = [p for w in words for p in w.split("-")]
        if strength == "naming":
            # behind a colon or the like, or two words up to something that ends them
            sure = len(words) > 1 or _END_OF_LOWER.match(text, end) and text[cue:start].strip()[-1:] in '":='
        else:
            sure = strength == "strong" and len(words) == 2 and text[end : end + 1] != ")"
            sure = sure or strength == "role" and len(words) == 2 and _PERSON_DOES.match(text, end)
        if parts[0] in self.given or parts[-1] in self.given or len(words) > 1 and words[-1] in self.known_words or sure:
            best[1].append((start, end))

    def _before(self, text: str, at: int, best: list) -> None:
        """A name that ends before a verb of people at `at`."""
        start, words = at, 0
        while start and words < 12 and text[start - 1] not in "\r\n":  # more than two names and a word between have
            start -= 1
            if text[start] in " \t " and text[start - 1] not in " \t ":
                words += 1
        part = text[start:at]
        last = _LAST_WORD.search(part.rstrip())
        if not last:
            return
        last = last[0]
        if not last[0].isupper() and not last.startswith(("al-", "d'", "d’")):
            m = _LOWER_END.search(part) if last.islower() else None
            if m:
                words = m["name"].split()
                sure = _CALLED.match(text, at) or _ALONE.match(text, at) and _AND.search(part[: m.start("name")])
                if words[0].split("-")[0] in self.given or words[-1] in self.known_words and words[0] not in NO_NAME or sure and self._unknown(words):
                    best[2].append((start + m.start("name"), start + m.end("name")))
            return
        m, paired = _NAME_END.search(part), False
        while m:
            span = self._trimmed(text, start + m.start(), start + len(m[0].rstrip()) + m.start(), leading=True)
            if not span:
                return
            value = text[slice(*span)]
            if value.isupper() and text[at : at + 3].isupper() and not any(w in self.given for w in re.split(r"[\s,\-]+", value.lower())):
                return
            one = not self._two_parts(value)
            both = _AND.search(text[start : span[0]])
            if one and not (_CALLED.match(text, at) or _ALONE.match(text, at) and (value.split("-")[0].lower() in self.given or value.endswith(".") or both or paired)):
                return
            best[1].append(span)
            paired = True
            before = part[: both.start()] + " " if both else ""
            m = _NAME_END.search(before)
            small = _LOWER_END.search(before) if not m and _ALONE.match(text, at) else None
            if small and self._unknown(small["name"].split()):
                best[2].append((start + small.start("name"), start + small.end("name")))

    def _unknown(self, words: list[str]) -> bool:
        """Whether none of the words, in small letters, is a common one."""
        return not any(w in NO_NAME and not (i == 0 and w in _BOTH) or w in _VERB_WORDS for i, w in enumerate(words))

    def _known(self, text: str, at: int, best: list) -> None:
        if at and text[at - 1] in "@/_.'’-":
            return
        m = self.known.match(text, at)
        if m and not _of_business(text, m.end()):
            shouted = m[0].isupper() and re.match(rf"{S}+[{_U}]+\b", text[m.end() : m.end() + 40]) and m[0].split()[-1].lower() not in self.given
            span = None if shouted else self._trimmed(text, at, m.end())
            if span:
                best[2].append(span)
        m = self.known_last.match(text, at)
        if m and at > 2 and text[at - 1] in " \t ":  # a family name and a comma before it
            comma = at - 1
            while comma and text[comma - 1] in " \t ":
                comma -= 1
            if comma and text[comma - 1] == ",":
                start = comma - 1
                while start and (text[start - 1].isalpha() or text[start - 1] in "'’-"):
                    start -= 1
                some = _PARTICLES_END.search(text[max(0, start - 24) : start])
                if re.fullmatch(_HYPHEN, text[start : comma - 1]) and not (start and text[start - 1] in "@_./"):
                    start -= len(some[0]) if some else 0
                    span = self._trimmed(text, start, m.end())
                    if span:
                        best[2].append(span)

    def _two_parts(self, value: str) -> bool:
        return len(re.findall(rf"[{_U}][\w'’.\-]*", value)) > 1

    def _trimmed(self, text: str, start: int, end: int, leading: bool = False) -> tuple[int, int] | None:
        """The span without words at its end (and, leading, at its start) that aren't names; None if nothing is left."""
        words = [(m.start(), m.end(), m[0]) for m in _WORDS.finditer(text, start, end)]
        both = lambda: len(words) > 1 and words[0][2].lower() in _BOTH and not self._no(words[-1][2])
        while leading and len(words) > 1 and self._no(words[0][2]) and not both():
            words.pop(0)
        if not words or self._no(words[0][2]) and not both():
            return None
        while len(words) > 1 and self._no(words[-1][2]):
            words.pop()
        a, b = words[0][0], words[-1][1]
        if _of_business(text, b) or self._no(words[-1][2]):
            return None
        if "." in text[b - 1 : b] and len(words[-1][2]) > 2:
            b -= 1
        return a, b

    def _no(self, word: str) -> bool:
        w = word.lower()
        return w in NO_NAME and w not in self.known_words


_PERSON_DOES = re.compile(rf"{S}+(?:was|is|has|had|{'|'.join(rf'{S}+'.join(map(re.escape, p.split())) for p in _phrases(VERBS))})(?!\w)", re.I)
_VERB_WORDS = frozenset(w for p in _phrases(VERBS) for w in p.split() if len(w) > 2) | {"evening", "promised", "bill"}
