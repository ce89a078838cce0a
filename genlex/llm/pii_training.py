"""Labelled sentences for training the personal-information model: a small generator of texts with known spans.

The number of sentences is a parameter of the model (a bounded sample); names, streets, numbers and sentences are made up here.
"""

from __future__ import annotations

import random

# Parts of invented values and sentences around them. {name} etc. are filled and labelled; {x...} are filled but no entity.
ONSETS = "Bar Bel Ber Bon Car Cha Cor Dan Del Des Du Fa Fer Gar Ger Gir Gran Ha Jou Lan Le Mar Mer Mo Mon Nor Pas Per Pi Ra Ri Ro Sa Sar Sim Ta Ter Val Ver Vi Zel".split()
CODAS = "ault bert bois dier don dot ein el eman fort gnon in ing kowski lard lier lin man mont nard neau net ois quet rand rier rin ron sen son tier ton vel vin ville zac ov ez".split()
GIVEN = "Ana Boris Céline Dario Elif Farid Greta Hugo Ingrid Jonas Kenji Leïla Milan Nadia Oskar Paloma Ravi Sofia Timo Ulla Viktor Wanda Yann Zeynep Aïcha Björn Chloé Dmitri Esteban Fatou".split()
STREETS = "Peupliers Lilas Vieux-Pont Gare Fontaine Platanes Grand-Chêne Chapelle Moissons Haut-Mur Écluse Remparts Cèdres Trois-Ponts Bas-Moulin".split()
STREETS_EN = "Oakfield|Riverside|Old Mill|Queens Hill|Copper|Maple|Station|High Barn|Willow|Long Meadow".split("|")
STREETS_DE = "Bahnhof Garten Linden Brunnen Kirch Schul Wald Mühlen Sonnen Ufer".split()
TOWNS = "Beauvallon Saint-Aubry Montreuilly Clairfont Ville-sur-Lys Pontarbois Larmont-la-Forêt Rochebrune".split()
TOWNS_EN = "Greenwich|Upper Norwood|Ashford|Little Haven|Stonebridge|Dunfield".split("|")
TOWNS_DE = "Oberdorf|Steinbach|Neuhausen|Waldkirch|Bad Sulz".split("|")
TOWNS_ES = "Villanera Monteblanco Ribalta Fuenclara Robledo".split()
NOUNS_DE = "Garten Fluss Weg Lehrer Schneider Vertrag Kuchen Bruder Schwester Fenster Markt Anfang Ende Abend Morgen Haus Katalog Brief Zettel Koch Fischer Sammlung Ordnung Frage Antwort Stadt Woche".split()
WORDS_FR = "le la les un une de du d'un d'une et ou ne pas plus que qui sous sur avec sans dans vers chaque gardien maître voisin miroir coffre lampe jardin tour vent pierre corde plume perdu rouillé tordue bleue garde partage découvre conclut rend cache voudrait pourtant souvent encore aussitôt prudence rose iris l'étain l'os l'aube qu'une n'ont".split()
DOMAINS = "exemple-poste bureau-net maison courriel lettre-rapide gazette orme-bleu".split()
TLDS = "fr com org net eu info de es".split()

FR = (
    "Contactez {title} {name} pour la suite.", "Le dossier de {title} {name} est complet.", "{name} habite au {addr}.", "{name} travaille à la mairie.", "Je suis {name} et je cherche un logement.", "Lettre signée {name}.", "Transmis par {name} hier soir.",
    "Selon {title} {name}, tout va bien.", "{name} et {name} ouvrent la séance.", "{name} (né à Lyon) et {name} tiennent le stand.", "Contact : {name} / {phone} / {email}", "Tél. {phone} ou {email}", "Appelez le {phone} après dix heures.", "On peut joindre {title} {name} au {phone}.",
    "Mon numéro est le {phone}, merci.", "Écrivez à {email} sans tarder.", "Mon adresse est {email}, à bientôt.", "Envoyez tout à {title} {name}, {addr}.", "Adresse : {addr}.", "Nous vivons au {addr} depuis mai.", "Rendez-vous devant le {addr}.", "Une plainte de {title} {name} vise le {addr}.",
    "Son {idlabel} {id} est sur la fiche.", "{title} {name} a montré son {idlabel} {id}.", "Le formulaire indique : {idlabel} {id}.", "mon tel c {phone} merci", "{title} {name} -- {email}", "\n{name}\n{addr}\n{phone}\n{email}", "\n{name}\n{addr}\n{email}", "{name}, {phone}", "Au bureau, {title} {name} a attendu.", "Auteur : {name}.",
    "La facture n° {xnum} est payée.", "Commande n° {xten} expédiée.", "L'ouvrage porte l'ISBN {xisbn}.", "Le lot {xlot} est prêt.", "Il y a {xsmall} rues dans ce bourg.", "La place du Marché est vide.", "La séance va de 08 h 15 à 17 h 30.", "Le billet passe de {xprice} à {xprice} euros.", "Version {xversion} publiée.", "Le {xdate}, on compte {xsmall} pages.",
    "{xgiven} est aussi le nom d'une plante, comme {xgiven}.", "Référence du paquet : {xref}.", "Mon compte est @{xpseudo} sur le site.", "Le numéro {xnum} du journal est sorti.", "{xgiven} arrive demain.", "Madame Bovary est un roman.", "Le chat dort sur une {xlower} {xadj}.", "Sous le {xlower} {xadj}, on parle.", "Le livre reste {xlower} {xadv} on le lit.", "Il agit par {xlower} {xadv} il peut.", "Un vieil {xlower} {xadj} penche.", "Rien n'est {xlower} {xadv} ici.", "Il réclame par {xlower} le miroir {xadj}.", "Elle affirme par {xlower} tenir la lampe.", "Selon {xlower} la cause reste floue.", "Le Petit Prince parle de {xgiven}.", "LE GRAND MIROIR RESTE DANS LA CAGE VIDE DU JARDIN.", "La Grande Halle ouvre.", "LE MAÎTRE DU MIROIR SOUTIENT DEVANT LE GARDIEN QUE LA CAGE RESTE VIDE.", "SANS MAÎTRE LA LAMPE BRÛLE, DITES CE QUE LE VOISIN FERAIT.", "{xupper}.", "{xupper} ?", "Voici la suite. {xupper}, {xupper}.", "{xupper} {name} habite au {addr}.", "M. {name} est arrivé.", "On attend M. {name}, dit-on.",
    "Tribunal : {title} {name}, {addr}. Autrefois la ville dormait.", "{addr} Depuis, tout a changé.", "{addr} Le soir tombe.", "Livraison au {addr}. {title} {name} signe.", "Le parc Victor compte {xsmall} arbres, série {xlot}.", "M. {xfamily} est absent.", "Madame {xfamily} parle peu.", "Le professeur attend {xgiven} devant la Mairie Centrale.",
)
EN = (
    "Please call {title_en} {name} on {phone_en}.", "The note was signed by {name}.", "We moved to {addr_en} last year.", "Write to {email} any time.", "My {idlabel_en} {id_en} is on the form.", "Ask {title_en} {name}, {addr_en}.", "\n{name}\n{addr_en}\n{phone_en}\n{email}", "Order {xten} was sent.", "The Old Mill is closed.", "Version {xversion} is out.",
    "It costs {xprice} dollars.", "{xupper}.", "On Monday the Long Road was empty.", "{title_en} {name} -- {email}", "{name} lives at {addr_en}.",
)
DE = (
    "Rufen Sie {title_de} {name} unter {phone_de} an.", "Der Brief ist von {title_de} {name}.", "Wir wohnen jetzt hier: {addr_de}.", "Bitte schreiben Sie an {email}.", "Die {idlabel_de} {id_de} steht auf dem Blatt.", "\n{name}\n{addr_de}\n{phone_de}\n{email}", "Der Müller ordnet das Verzeichnis der Berufe.", "Die junge Schreiberin liest den Entwurf des Leitfadens.",
    "Das Wort bezeichnet eine Person auf Wunsch des Rates.", "Zum Beispiel gilt der Bericht der Sitzung.", "Niemand kennt die Tabelle der Endungen im Lehrbuch.", "{title_de} {name} -- {email}", "Rechnung {xten} ist bezahlt.", "Der alte {xnoun} liest den {xnoun} des {xnoun}s.", "Ein {xnoun} ordnet zuerst die {xnoun} der {xnoun} und dann den {xnoun}.", "Wenn die {xnoun} im {xnoun} {xnoun} kopiert, wartet man auf {xnoun} des {xnoun}s.", "Jeder {xnoun} prüft das {xnoun} für {xnoun}.", "Zum {xnoun} gilt: eine {xnoun} behält den {xnoun} des {xnoun}s.", "Niemand weiß, ob der {xnoun} in der {xnoun} des {xnoun}s bleibt.", "Die Karte liegt bei Schnee. Ein Buchbinder liest.", "Er wohnt bei Freunden. Eine Übersetzerin schreibt von Hand.",
)
ES = (
    "Llame a {title_es} {name} al {phone_es}.", "La carta es de {title_es} {name}.", "Vivimos en {addr_es} desde mayo.", "Escriba a {email} cuando quiera.", "Su {idlabel_es} {id_es} aparece en la ficha.", "\n{name}\n{addr_es}\n{phone_es}\n{email}", "La Plaza Mayor está llena.", "El pedido {xten} salió ayer.", "{title_es} {name} -- {email}", "Primero la panadera guarda el mapa.",
)


class _Maker:
    def __init__(self, seed: int, listed: list[str]):
        self.r = random.Random(seed)
        self.listed = [n[:1].upper() + n[1:] for n in listed] or GIVEN

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        return self.r.choice(ONSETS) + self.r.choice(CODAS)

    def given(self) -> str:
        one = lambda: self.r.choice(self.listed if self.r.random() < 0.65 else GIVEN)
        return f"{one()}-{one()}" if self.r.random() < 0.15 else one()

    def name(self) -> str:
        family = self.family()
        form = self.r.random()
        if form > 0.93:
            return f"{self.r.choice(self.listed)} {family}".lower()
        if form < 0.12:
            return f"{family.upper()} {self.given()}"
        if form < 0.22:
            return f"{self.given()} {family.upper()}"
        if form < 0.30:
            return f"{self.r.choice('ABCDEFGHJKLMNOPRSTVWYZ')}. {family}"
        if form < 0.38:
            return f"{self.given()} de {family}"
        if form < 0.45:
            return f"{self.given()} Le {family}"
        return f"{self.given()} {family}"

    def phone(self) -> str:
        r, pairs = self.r, [self.digits(2) for _ in range(4)]
        lead = r.choice("12345679")
        sep = r.choice([" ", " ", ".", "-", ""])
        head = r.choice([f"0{lead}", f"0{lead}", f"+33 {lead}", f"+33 (0){lead}", f"0033{lead}"])
        return sep.join([head, *pairs]) if head[0] != "+" else " ".join([head, *pairs])

    def phone_en(self) -> str:
        return self.r.choice([f"{self.r.randint(201, 989)}-555-{self.digits(4)}", f"+1 ({self.r.randint(201, 989)}) 555-{self.digits(4)}", f"07{self.digits(3)} {self.digits(6)}", f"+44 7{self.digits(3)} {self.digits(6)}", f"07{self.digits(3)} {self.digits(3)} {self.digits(3)}", f"({self.r.randint(201, 989)}) 555-{self.digits(4)}"])

    def phone_de(self) -> str:
        return self.r.choice([f"0049 {self.r.choice(['30', '40', '89'])} {self.digits(5)} {self.digits(3)}", f"+49 {self.r.choice(['30', '40', '89'])} {self.digits(5)}-{self.digits(3)}", f"(0{self.r.choice(['30', '40', '89'])}) {self.digits(8)}", f"0{self.r.choice(['30', '89'])} {self.digits(7)}", f"0{self.r.choice(['30', '89'])}/{self.digits(5)}-{self.digits(3)}"])

    def phone_es(self) -> str:
        body = [self.r.choice("6795") + self.digits(2), self.digits(3), self.digits(3)]
        sep = self.r.choice([" ", "-"])
        return self.r.choice([" ".join(body), "+34 " + " ".join(body), "+34" + sep + sep.join(body), "".join(body)])

    def email(self) -> str:
        r = self.r
        family, given = self.family().lower(), "".join(c for c in r.choice(GIVEN).lower() if c.isascii())
        local = r.choice([f"{given}.{family}", family, f"{family}_{given}{self.digits(2)}", f"{given}+liste", f"{given[0]}{family}"])
        domain, tld = r.choice(DOMAINS), r.choice(TLDS)
        if r.random() < 0.2:
            domain = f"courrier.{domain}"
        form = r.random()
        if form < 0.12:
            return f"{local} [{r.choice(['arobase', 'at'])}] {domain.replace('.', ' point ')} point {tld}"
        if form < 0.2:
            return f"{local} (at) {domain}.{tld}"
        if form < 0.3:
            return f"{local} @ {domain.replace('.', ' . ')} . {tld}"
        whole = f"{local}@{domain}.{tld}"
        return whole.upper() if form < 0.4 else whole

    def _town(self, town: str) -> str:
        code = self.digits(5)
        return self.r.choice(["", f", {town}", f", {code} {town}", f" {code} {town}", f" - {code} {town}"])

    def addr(self) -> str:
        r = self.r
        number = f"{r.randint(1, 180)}" + r.choice(["", "", "", " bis", " ter", "B"])
        street = r.choice(["rue", "avenue", "av.", "boulevard", "bd", "place", "chemin", "impasse", "allée", "quai", "route", "square"])
        name = r.choice([f"des {r.choice(STREETS)}", f"du {r.choice(STREETS)}", f"de la {r.choice(STREETS)}", f"de l'{r.choice(['Écluse', 'Ancien-Four', 'Hôtel-Vieux'])}", f"aux {r.choice(STREETS)}", self.family(), f"du {r.choice(['Pont', 'Moulin', 'Four'])} {r.choice(['Neuf', 'Brisé', 'Rouge'])}", f"{r.choice(GIVEN)} {self.family()}"])
        whole = f"{number}{r.choice([' ', ', '])}{street} {name}{self._town(r.choice(TOWNS))}"
        return whole.upper() if r.random() < 0.1 else whole

    def addr_en(self) -> str:
        return f"{self.r.randint(1, 180)} {self.r.choice(STREETS_EN)} {self.r.choice(['Street', 'Road', 'Lane', 'Avenue'])}" + self.r.choice(["", f", {self.r.choice(TOWNS_EN)}"])

    def addr_de(self) -> str:
        street = self.r.choice([f"{self.r.choice(STREETS_DE)}{self.r.choice(['straße', 'gasse', 'weg', 'platz'])}", f"Am {self.r.choice(['Neuen Tor', 'Markt', 'Hohen Ufer'])}"])
        return f"{street} {self.r.randint(1, 180)}" + self.r.choice(["", f", {self.r.choice(TOWNS_DE)}", f", {self.digits(5)} {self.r.choice(TOWNS_DE)}"])

    def addr_es(self) -> str:
        street = self.r.choice(["calle", "avenida", "plaza", "paseo"]) + self.r.choice([" de los Olmos", " del Prado", " Cervera", " de la Fuente", " de las Eras"])
        return f"{street} {self.r.choice(['', 'n.º '])}{self.r.randint(1, 180)}" + self.r.choice(["", f", {self.digits(5)} {self.r.choice(TOWNS_ES)}"])

    def id(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        nir = [r.choice("12"), d(2), f"{r.randint(1, 12):02d}", d(2), d(3), d(3), d(2)]
        return r.choice([
            (r.choice(["numéro de sécurité sociale", "NIR :", "n° SS", "immatriculation"]), r.choice([" ".join(nir), "".join(nir), "".join(nir[:-1]) + " " + nir[-1]])),
            (r.choice(["passeport", "passeport n°", "passeport numéro"]), f"{d(2)}{r.choice('ABCXZ')}{r.choice('CDEZ')}{d(5)}"),
            (r.choice(["carte d'identité", "carte d'identité n°", "CNI"]), f"{d(2)}{r.choice('ABX')}{d(1)}{r.choice('CDK')}{d(2)}{r.choice('FGP')}{d(1)}"),
            (r.choice(["numéro fiscal", "numéro fiscal :"]), f"{r.randint(0, 39):02d} {d(2)} {d(3)} {d(3)} {d(3)}"),
        ])

    def id_en(self) -> tuple[str, str]:
        n = [self.r.choice(["QQ", "AB", "JK"]), self.digits(2), self.digits(2), self.digits(2), self.r.choice("ABCD")]
        return self.r.choice(["national insurance number", "NI no.", "NI number"]), self.r.choice(["".join(n), " ".join(n)])

    def id_de(self) -> tuple[str, str]:
        return self.r.choice(["Ausweisnummer", "Personalausweis", "Ausweisnummer:"]), f"{self.r.choice('LTC')}{self.digits(2)}{self.r.choice(['ZZ', 'XK'])}{self.digits(4)}"

    def id_es(self) -> tuple[str, str]:
        return self.r.choice(["DNI", "documento", "DNI:"]), self.digits(8) + self.r.choice(["", "-K", "R", "J"])

    def fill(self, key: str, state: dict) -> tuple[str, str | None]:
        r, d = self.r, self.digits
        kind = {"name": "name", "phone": "phone", "email": "email", "addr": "address", "id": "id_number"}.get(key.split("_")[0])
        if key.startswith("idlabel"):
            state["id"] = getattr(self, "id" + key[7:])()
            return state["id"][0], None
        if key.startswith("id"):
            return state["id"][1], kind
        if key.startswith("title"):
            return r.choice({"": ["M.", "Mme", "Madame", "Monsieur", "Maître", "Dr"], "_en": ["Mr", "Ms", "Mrs", "Dr"], "_de": ["Herr", "Frau"], "_es": ["el señor", "la señora"]}[key[5:]]), None
        if kind:
            return getattr(self, key)(), kind
        plain = {
            "xnum": d(4), "xten": "20" + d(8), "xisbn": f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", "xlot": f"{d(6)} {d(4)}", "xsmall": str(r.randint(2, 99)), "xprice": f"{d(3)},50", "xversion": f"{d(1)}.{d(2)}.{d(1)}.{d(2)}", "xdate": f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/20{d(2)}",
            "xref": f"{r.choice(['FR', 'DE', 'EU'])}-{d(6)}-{d(3)}", "xnoun": r.choice(NOUNS_DE), "xlower": r.choice(self.listed).lower(), "xadj": r.choice("plate grise tordu rouge bleue cassée promise fanée lourd".split()), "xadv": r.choice("tenir comment parfois surtout regrettée pourtant tantôt dire".split()), "xupper": " ".join(r.choice(WORDS_FR) for _ in range(r.randint(4, 14))).upper(), "xpseudo": f"plume{d(3)}", "xgiven": r.choice(self.listed), "xfamily": self.family(),
        }
        return plain[key], None


def labelled_texts(n: int, seed: int, listed: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to three sentences with their entity spans (start, end, kind). The same arguments give the same texts."""
    import re

    m = _Maker(seed, listed)
    out = []
    for _ in range(n):
        bank = m.r.choice([FR, FR, FR, EN, DE, ES])
        text, spans = "", []
        for _ in range(m.r.randint(1, 3)):
            if text and not text.endswith("\n"):
                text += " "
            state: dict = {}
            for piece in re.split(r"(\{\w+\})", m.r.choice(bank)):
                if piece.startswith("{"):
                    value, kind = m.fill(piece[1:-1], state)
                    if kind:
                        spans.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += piece
        out.append((text, spans))
    return out
