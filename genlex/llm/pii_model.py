"""The semi-Markov conditional random field behind ``pii``: candidates, whole-span features, decoding and training.

A text is segmented into ordinary characters and typed entity segments. Any span that one of the grammars below proposes,
with or without its optional parts, is a candidate segment; its score is the sum of the weights of features of the whole span
and its surroundings, plus the weight of the transition from what stands before it. Bounded-entity dynamic programming finds the
best segmentation, choosing boundaries and types together: no segment is longer than the longest candidate of its text, a bound
that never loses a value. Weights maximise the conditional likelihood (forward-backward over the same lattice), trained here on
sentences written by ``pii_training``.
"""

from __future__ import annotations

import math
import re
from functools import cache

from .defects import FUNCTION_WORDS

KINDS = ("email", "phone", "id_number", "address", "name")
U, L = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿœæ"
GAP = "[ \\u00a0\\u202f\\u2009\\u2007]"

# Words that tell what a number or a capitalised word is (lower case).
TITLES = "m mr mme mlle mm me dr pr prof monsieur madame mademoiselle messieurs mesdames maître docteur professeur sir mrs ms miss mx lord lady herr frau hr fr señor señora señorita sr sra srta don doña signor signora".split()
PHONE_CUES = "tél tel téléphone telephone phone portable mobile fixe fax call appeler appelez appelle rappeler rappelez joindre numéro num number unter telefon ruf rufen handy teléfono móvil llame llamar répondeur whatsapp sms contact au".split()
ID_CUES = "passeport passport identité identity cni fiscal fiscale sociale sécurité nir ss insee immatriculation insurance ni nino ssn ausweisnummer personalausweis ausweis reisepass steuernummer dni nie nif documento pasaporte carte permis license licence sozialversicherungsnummer tax".split()
OTHER_CUES = "commande lot isbn issn colis référence ref réf revue version facture tirage rayon étagère article page pages prix francs euros série modèle order invoice batch issue bestellung rechnung ausgabe pedido factura lote code ticket dossier".split()
NAME_CUES = "signé signée signés par contact appelle appelé joindre selon ask call by from von bei nommé nommée dénommé auteur autrice rédigé envoyé".split()
STREET_FR = "rue|avenue|av\\.?|boulevard|boul\\.?|bd\\.?|bld\\.?|place|pl\\.|chemin|che?m?\\.|impasse|imp\\.|allées?|quai|route|rte\\.?|square|sq\\.|cours|passage|sentier|voie|faubourg|fg\\.?|ruelle|esplanade|promenade|mail|villa|cité|résidence|lotissement|hameau|venelle|traverse|rond-point|montée|côte|parvis"
STREET_EN = "Street|Road|Lane|Avenue|Drive|Close|Court|Way|Place|Square|Terrace|Crescent|Gardens|Hill|Row|Walk|Grove|Park|Boulevard|Parade|Mews|Rise"
STREET_EN_SHORT = "St|Rd|Ave|Ln|Dr|Blvd"
STREET_DE = "stra(?:ß|ss)e|str\\.|gasse|weg|platz|allee|ufer|damm|ring|steig|hof|pfad|chaussee|markt|graben|berg|tor"
STREET_ES = "calle|c/|avenida|avda?\\.?|plaza|pza\\.?|paseo|camino|carrera|carretera|ronda|travesía|callejón|glorieta|bulevar"

_GERMAN = frozenset("der die das den dem des ein eine einen und ist nicht mit auf von zum zur ich sie wir im am zu".split())
_FUNCTION = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split()) | frozenset("de la le les du des un une et est sont on se ni or lorsque quand sachant seul seule nul".split())
_CAP = f"[{U}][{U}{L}'’]*(?:-[{U}{L}]['’{U}{L}]*)*"
_LINK = "(?:de la |de l['’]|de |du |des |d['’]|la |le |les |l['’]|aux |au |à la |à l['’]|à |en |sous |sur |saint-)"
_TOWN = f"{_CAP}(?:{GAP}(?:{_CAP})){{0,2}}"
_POSTTOWN = f"(?:{GAP}*[,–-]{GAP}*|{GAP}+)(?:(?:[A-Z]{{1,2}}-)?\\d{{4,5}}){GAP}+{_TOWN}"
_TAIL = f"(?P<tail>{_POSTTOWN}|{GAP}*,{GAP}*{_TOWN})?"
_NUM = "\\d{1,4}(?:(?:bis|ter|quater|[A-Fa-f])(?![\\w])|[ \\u00a0](?:bis|ter|quater|BIS|TER|QUATER|[A-F])(?![\\w'’]))?"

ADDRESSES = (
    ("fr", re.compile(f"(?<![\\w@.,/-]){_NUM},?{GAP}+(?i:{STREET_FR}){GAP}+(?i:{_LINK})*(?P<street>{_CAP}(?:{GAP}(?:(?i:{_LINK})*)(?:{_CAP})){{0,3}}){_TAIL}")),
    ("en", re.compile(f"(?<![\\w@.,/-])\\d{{1,4}}[A-Fa-f]?{GAP}+(?P<street>(?:{_CAP}{GAP}+){{1,3}}(?:(?:{STREET_EN})(?![\\w])|(?:{STREET_EN_SHORT})(?![\\w])\\.?)){_TAIL}(?P<post>,?{GAP}+[A-Z]{{1,2}}\\d[A-Z\\d]?{GAP}\\d[A-Z]{{2}}(?!\\w))?")),
    ("de", re.compile(f"(?<![\\w])(?P<street>(?:[{U}][{L}]+-)*(?:[{U}][{L}]*(?:{STREET_DE})|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Hinter der|Unter den)(?:{GAP}{_CAP}){{1,2}}|{_CAP}{GAP}(?:Straße|Platz|Weg|Allee|Ring|Gasse))){GAP}+\\d{{1,4}}(?:{GAP}?[a-f](?!\\w))?{_TAIL}")),
    ("es", re.compile(f"(?<![\\w])(?i:{STREET_ES}){GAP}*(?i:(?:de los |de las |de la |del |de |los |las |la |el )*)(?P<street>{_CAP}(?:{GAP}(?:(?:de|del|la|los|las|y){GAP})*(?:{_CAP})){{0,3}}),?{GAP}+(?:(?:n\\.?{GAP}?[º°o]|nº|núm\\.?|número){GAP}*)?\\d{{1,4}}(?:{GAP}?[A-Fa-f](?!\\w))?{_TAIL}")),
)
PHONE = re.compile("(?<![\\w@./+-])(?:\\+|\\()?\\d(?:[\\d()./\\u00a0\\u202f\\u2009 -]{5,22})\\d(?![\\w@])")
IDENT = re.compile(
    f"(?<![\\w@./-])(?:[12]{GAP}?\\d{{2}}{GAP}?\\d{{2}}{GAP}?(?:\\d{{2}}|2[AB]){GAP}?\\d{{3}}{GAP}?\\d{{3}}(?:{GAP}?\\d{{2}})?|[0-3]\\d{GAP}\\d{{2}}{GAP}\\d{{3}}{GAP}\\d{{3}}{GAP}\\d{{3}}|[A-Z]{{2}}{GAP}?\\d{{2}}{GAP}?\\d{{2}}{GAP}?\\d{{2}}{GAP}?[A-D]|\\d{{3}}-\\d{{2}}-\\d{{4}}"
    "|[XYZ]-?\\d{7}-?[A-Z]|\\d{8}-?[A-Z]?|(?=(?:[A-Z]*\\d){5})[A-Z0-9]{8,18}|\\d{2,4}(?:[ .-]\\d{2,4}){2,5})(?![\\w@])"
)
_AT = "(?:@|[\\[({<]{0}(?:at|arobase|arroba|a|à|chez){0}[\\])}>]|(?<= )(?:arobase|arroba)(?= ))".replace("{0}", GAP + "?")
_DOT = "(?:(?<! )\\.(?! )|(?<= )\\.(?= )|[\\[({]{0}(?:\\.|dot|point|punto|punkt|pt){0}[\\])}]|(?<=[ \\u00a0])(?:point|dot|punto|punkt)(?=[ \\u00a0]))".replace("{0}", GAP + "?")
_SP = "[ \\u00a0]?"
EMAIL = re.compile(f"(?<![\\w.+-])[A-Za-z0-9À-ÿ][\\wÀ-ÿ.+%-]*{_SP}{_AT}{_SP}[A-Za-z0-9À-ÿ-]+(?:{_SP}{_DOT}{_SP}[A-Za-z0-9À-ÿ-]+)+", re.I)
_NAME_WORD = f"(?:[{U}]['’])?[{U}][{U}{L}]+(?:['’][{U}][{U}{L}]+)?"
_NAME_TOKEN = f"(?:[{U}]\\.(?:[ -]?[{U}]\\.)*|{_NAME_WORD}(?:-{_NAME_WORD})*)"
_PARTICLE = "(?:de la|de|du|d['’]|Le|La|Du|De|Des|von der|von|van der|van den|van|zu|del|della|di|da|dos|El|Mac|Mc|O['’])"
NAME_RUN = re.compile(f"(?<![\\w@.+/'’-]){_NAME_TOKEN}(?:{GAP}(?:{_PARTICLE}{GAP}?)?{_NAME_TOKEN})+(?![\\w@·•])")
LOWER_NAME = re.compile(f"(?<![\\w@.+/'’-])([{L}]{{3,}}(?:-[{L}]{{3,}})?){GAP}((?:de{GAP}|le{GAP}|la{GAP}|du{GAP}|d['’])?([{L}]{{3,}}(?:-[{L}]{{3,}})*))(?![\\w@'’-])")
_NAME_PART = re.compile(f"{_NAME_TOKEN}|(?:de la|von der|van der|van den|de|du|d['’]|von|van|zu|del|della|di|da|dos)(?={GAP}|[{U}])")
_PARTICLES = frozenset("de la du des d' d’ le la les von van der den zu del della di da dos el".split())


def normal_given(names: list[str]) -> frozenset[str]:
    return frozenset(n.strip().lower() for n in names if n and n.strip())


def _shape(s: str) -> str:
    s = re.sub(r"\d+", lambda m: "9" * min(len(m.group()), 5), s)
    return re.sub(f"[{U}]", "A", re.sub(f"[{L}]", "a", s))[:32]


def _token_class(t: str, given: frozenset[str]) -> str:
    low = t.lower()
    if low in _PARTICLES:
        return "P"
    if re.fullmatch(f"(?:[{U}]\\.[ -]?)+", t):
        return "I"
    if any(p in given for p in [low, *low.split("-")]):
        return "G"
    if low.rstrip(".") in TITLES:
        return "T"
    if low in _FUNCTION:
        return "F"
    return "A" if t.isupper() and len(t) > 1 else "C"


def candidates(text: str, given: frozenset[str]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, own features) of every proposed segment; the same span may be proposed for several kinds."""
    out: dict[tuple[int, int, str], list[str]] = {}

    def put(a: int, b: int, kind: str, feats: list[str]) -> None:
        if b > a and (a, b, kind) not in out:
            out[a, b, kind] = feats

    for m in EMAIL.finditer(text):
        s = m.group()
        domain = re.split(r"@|[\[({<]|arobase|arroba", s, maxsplit=1, flags=re.I)[1]
        put(m.start(), m.end(), "email", ["plain" if re.fullmatch(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", s) else "disguised", f"labels={min(4, len(re.findall(r'[.]|point|dot|punto|punkt', domain, re.I)))}"])
        tail = re.search(r"\.[A-Za-z0-9-]*$", s)
        if tail and "@" in s[: tail.start()]:
            put(m.start(), m.start() + tail.start(), "email", ["cut"])
    if re.search(r"\d", text):
        for language, pattern in ADDRESSES:
            for m in pattern.finditer(text):
                _address_options(text, m, language, put)
        for m in PHONE.finditer(text):
            _phone_options(text, m, put)
        for m in IDENT.finditer(text):
            s = m.group()
            digits = sum(c.isdigit() for c in s)
            put(m.start(), m.end(), "id_number", [f"shape={_shape(s)}", f"digits={min(digits, 16)}", "letters" if re.search("[A-Z]", s) else "numbers only"])
    for m in NAME_RUN.finditer(text):
        _name_options(text, m, given, put)
    at = 0
    while m := LOWER_NAME.search(text, at):
        at = m.end(1)
        if all(p in given for p in m.group(1).split("-")) and m.group(3) not in _FUNCTION:
            put(m.start(), m.end(), "name", ["classes=" + ("gpc" if len(m.group(2)) > len(m.group(3)) else "gc"), "lower"])
    return [(a, b, kind, feats) for (a, b, kind), feats in out.items()]


def _address_options(text: str, m: re.Match, language: str, put) -> None:
    feats = [f"grammar={language}"]
    words = list(re.finditer(_CAP, m.group("street")))
    if m.group("street").upper() == m.group("street"):
        feats.append("upper")
    tail = m.group("tail")
    stop = m.end("tail") if tail else m.end()
    if language == "en" and m.group("post"):
        put(m.start(), m.end("post"), "address", [*feats, "postcode", "town"])
    if tail:
        towns = list(re.finditer(_CAP, tail))
        coded = bool(re.search(r"\d", tail))
        for k, w in enumerate(towns):
            odd = any(t.group().lower() in _FUNCTION or t.group().lower() in TITLES for t in towns[: k + 1])
            put(m.start(), m.start("tail") + w.end(), "address", [*feats, "town", f"town words={k + 1}", "coded" if coded else "uncoded", *(["odd word"] if odd else [])])
        stop = m.start("tail")
    put(m.start(), stop, "address", [*feats, "no tail", *(["tail left"] if tail else [])])
    if language == "fr":
        for k, w in enumerate(words[:-1]):
            rest = words[k + 1].group().lower()
            put(m.start(), m.start("street") + w.end(), "address", [*feats, "no tail", "street cut", "cut before function word" if rest in _FUNCTION or rest in TITLES else "cut before word"])
        if any(w.group().lower() in _FUNCTION or w.group().lower() in TITLES for w in words[1:]):
            for key in [(m.start(), stop, "address")]:
                put(*key, [])


def _phone_options(text: str, m: re.Match, put) -> None:
    s = m.group()
    digits = re.sub(r"\D", "", s)
    if not 7 <= len(digits) <= 15:
        return
    form = "other"
    if re.fullmatch(r"0[1-9](?:[ .\-   ]?\d{2}){4}", s):
        form = "fr"
    elif re.fullmatch(r"(?:\+33|0033)[ .\- ]?(?:\(0\)[ ]?)?[1-9](?:[ .\- ]?\d{2}){4}", s):
        form = "fr abroad"
    elif re.fullmatch(r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-/ ]?\(?\d{1,5}\)?){1,6}", s) and 9 <= len(digits) <= 15:
        form = "abroad"
    elif re.fullmatch(r"\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", s):
        form = "us"
    elif re.fullmatch(r"\(0\d{1,5}\)[ \-/]?\d{3,9}(?:[ \-]\d{2,5})*|0\d{2,5}[ /\-]\d{3,8}(?:[ \-]\d{2,4})*", s):
        form = "area"
    elif re.fullmatch(r"[5-9]\d{2}[ .\-]?\d{3}[ .\-]?\d{3}|[5-9]\d{2}(?:[ .\-]?\d{2}){3}", s):
        form = "nine"
    elif re.fullmatch(r"\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|97[89][- ].*", s):
        form = "date or book"
    elif re.fullmatch(r"\d+(?:\.\d+){2,}", s) and any(len(p) == 1 for p in s.split(".")):
        form = "version"
    put(m.start(), m.end(), "phone", [f"form={form}", f"digits={len(digits)}", f"first={digits[0]}"])


def _name_options(text: str, m: re.Match, given: frozenset[str], put) -> None:
    parts = [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in _NAME_PART.finditer(m.group())]
    parts = [(a + 3, b, t[3:]) if re.match(f"M\\.{GAP}[{U}]\\.", t) else (a, b, t) for a, b, t in parts]  # monsieur before an initial
    classes = [_token_class(t, given) for _, _, t in parts]
    for i in range(len(parts)):
        if classes[i] in "PTF" and parts[i][2].lower() not in given:
            continue
        if parts[i][2] == "M." and not re.search(f"(?i)(?:{'|'.join(TITLES)})\\.?{GAP}$", text[max(0, parts[i][0] - 14) : parts[i][0]]):
            continue  # monsieur
        for j in range(i + 1, min(len(parts), i + 6)):
            if classes[j] in "PI":
                continue
            inner = classes[i : j + 1]
            if "F" in inner or "T" in inner[1:]:
                continue
            pattern = "".join(inner)
            own = [f"classes={pattern}", f"upper={''.join('1' if t.isupper() and len(t) > 2 else '0' for _, _, t in parts[i : j + 1] if t.lower() not in _PARTICLES)}"]
            before, after = parts[i - 1][2] if i else "", parts[j + 1][2] if j + 1 < len(parts) else ""
            if before:
                own.append(f"run before={classes[i - 1]}")
            if after:
                own.append(f"run after={classes[j + 1]}")
            if "G" in pattern:
                own.append("given")
            if pattern[0] in "GI" or "G" in pattern[-1]:
                own.append("given at edge")
            put(parts[i][0], parts[j][1], "name", own)


def surroundings(text: str, a: int, b: int, kind: str) -> list[str]:
    """Features of the words round a segment: cue classes on the left, what follows, and whether it has a line to itself."""
    left = re.findall(r"[^\W\d_]+|\d+|[^\w\s]|\n", text[max(0, a - 40) : a])
    words: list[str] = []
    for k in range(len(left) - 1, -1, -1):  # back to the end of the sentence before; a full stop after a short word may be an abbreviation's
        t = left[k]
        if t in "\n!?" or (t == "." and not (k and left[k - 1].isalpha() and len(left[k - 1]) <= 3)):
            break
        if t.isalnum():
            words.insert(0, "" if t.isupper() and len(t) > 4 and t.lower() in TITLES else t.lower())
    out = []
    near = words[-3:]
    for label, cues, reach in (("title", TITLES, 1), ("phone cue", PHONE_CUES, 3), ("id cue", ID_CUES, 3), ("other cue", OTHER_CUES, 3), ("name cue", NAME_CUES, 2)):
        hit = next((k for k, w in enumerate(reversed(near[-reach:])) if w in cues), None)
        if hit is not None:
            out.append(f"{label}")
    line_start = not text[:a].strip(" \t ") or text[:a].rstrip(" \t ").endswith("\n")
    line_end = b == len(text) or text[b:].lstrip(" \t ").startswith("\n") or not text[b:].strip()
    out.append(f"line={int(line_start)}{int(line_end)}")
    if kind == "name":
        if line_start and line_end and re.match(r"\s*\n[^\n]*(?:\d|@)", text[b:]):
            out.append("heads contact lines")
        before = text[max(0, a - 2) : a].strip()
        out.append("sentence start" if (not before or before[-1] in ".!?\n") and not line_start else "inside")
        after = re.match(r"\s*(\S+)", text[b : b + 24])
        nxt = after.group(1) if after else ""
        out.append("next=" + ("digit" if nxt[:1].isdigit() else "dash" if nxt[:1] in "-–—/|" else "paren" if nxt[:1] == "(" else "stop" if nxt[:1] in ".,;:!?" else "upper" if nxt.isupper() and len(nxt) > 1 else "cap" if nxt[:1].isupper() else "low" if nxt else "end"))
        german = sum(w in _GERMAN for w in re.findall(r"[^\W\d_]+", (text[max(0, a - 80) : a] + " " + text[b : b + 80]).lower()))
        out.append("german" if german >= 2 else "not german")
        if nxt.lower() in _FUNCTION and nxt[:1].islower():
            out.append("next function word")
        around = re.findall(r"[^\W\d_]{2,}", text[max(0, a - 40) : a])[-1:] + re.findall(r"[^\W\d_]{2,}", text[b : b + 40])[:1]
        if around and text[a:b].isupper():
            out.append(f"upper case, {sum(w.isupper() for w in around)} of {len(around)} neighbours too")
    elif re.match(r"[\w@]|[-/.,]\d", text[b : b + 2] or " "):
        out.append("number goes on")
    if kind in ("phone", "id_number") and text[max(0, a - 2) : a].strip()[-1:] in "-/.,":
        out.append("joined on the left")
    return out


def features(text: str, a: int, b: int, kind: str, own: list[str]) -> list[str]:
    around = surroundings(text, a, b, kind)
    out = [f"{kind}|bias", *(f"{kind}|{f}" for f in own), *(f"{kind}|{f}" for f in around)]
    if kind == "name":
        cued = next((c for c in ("title", "name cue", "heads contact lines") if c in around), "bare")
        german = "german" if "german" in around else "not german"
        if "lower" in own:
            before = re.search(r"([^\W\d_]+)['’\s]*$", text[max(0, a - 16) : a])
            out.append("name|lower after " + ("function word" if before and before.group(1).lower() in _FUNCTION and cued == "bare" and "inside" in around else cued))
            out += [f"name|lower {f}" for f in around if f.startswith(("line", "next", "sentence", "inside"))]
        out += [f"name|{own[0]} {cued}", f"name|{own[0]} {german}", f"name|{own[0]} {cued} {german}"]
    elif kind in ("phone", "id_number"):
        cued = next((c for c in ("other cue", "id cue", "phone cue") if c in around), "bare")
        out.append(f"{kind}|{own[0]} {cued}")
    return out


def lattice(text: str, given: frozenset[str]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """Candidate segments as (first place, end place, start, end, kind, features).

    Places count the characters that are not blank, so segments with only blanks between them touch. Every candidate is in the
    lattice, whatever its length and whatever signs it starts or ends with.
    """
    found = candidates(text, given)
    place, at, seen = {}, 0, 0
    for edge in sorted({x for a, b, _, _ in found for x in (a, b)}):
        seen += len("".join(text[at:edge].split()))
        place[edge], at = seen, edge
    return [(place[a], place[b], a, b, kind, features(text, a, b, kind, own)) for a, b, kind, own in found]


def chains(segments: list) -> list[list[int]]:
    """Stretches of overlapping or touching segments, by start; segments with ordinary text between them do not influence each other.

    Time and memory thus follow the candidates, not the length of the text.
    """
    order = sorted(range(len(segments)), key=lambda k: segments[k][0])
    out: list[list[int]] = []
    end = -1
    for k in order:
        if out and segments[k][0] <= end:
            out[-1].append(k)
        else:
            out.append([k])
            end = segments[k][1]
        end = max(end, segments[k][1])
    return out


def _places(segments: list, stretch: list[int]) -> tuple[list[tuple[int, int]], int]:
    """((first, end) of each segment of the stretch, number of places): only places where a segment starts or ends are kept."""
    index = {x: n for n, x in enumerate(sorted({x for k in stretch for x in segments[k][:2]}))}
    return [(index[segments[k][0]], index[segments[k][1]]) for k in stretch], len(index)


def viterbi(segments: list, weights: dict[str, float]) -> list[int]:
    """Indices of the best set of segments that do not overlap; ordinary text scores 0, each segment has the weight of its transition."""
    chosen: list[int] = []
    for stretch in chains(segments):
        chosen += _best_path(segments, stretch, weights)
    return chosen


def _best_path(segments: list, stretch: list[int], weights: dict[str, float]) -> list[int]:
    spans, n = _places(segments, stretch)
    by_end: list[list[int]] = [[] for _ in range(n)]
    for j, (_, end) in enumerate(spans):
        by_end[end].append(j)
    # best[t][last kind]: (score, segment that ends here or -1, last kind before it); "O" after ordinary text
    best: list[dict[str, tuple[float, int, str]]] = [{"O": (0.0, -1, "")}]
    for t in range(1, n):
        last, (s, _, _) = max(best[t - 1].items(), key=lambda x: x[1][0])
        here: dict[str, tuple[float, int, str]] = {"O": (s, -1, last)}
        for j in by_end[t]:
            kind = segments[stretch[j]][4]
            prev, s = max(((p, v[0] + weights.get(f"{p}>{kind}", 0.0)) for p, v in best[spans[j][0]].items()), key=lambda x: x[1])
            s += sum(weights.get(f, 0.0) for f in segments[stretch[j]][5])
            if kind not in here or s > here[kind][0]:
                here[kind] = (s, j, prev)
        best.append(here)
    t, last, path = n - 1, max(best[-1].items(), key=lambda x: x[1][0])[0], []
    while t > 0:
        _, j, prev = best[t][last]
        if j >= 0:
            path.append(stretch[j])
            t, last = spans[j][0], prev
        else:
            t, last = t - 1, prev
    return path[::-1]


def decode(text: str, weights: dict[str, float], given: frozenset[str]) -> list[tuple[int, int, str]]:
    segments = lattice(text, given)
    return [(segments[k][2], segments[k][3], segments[k][4]) for k in viterbi(segments, weights)]


def _add(table: dict[str, float], key: str, value: float) -> None:
    """log(exp(old) + exp(value))"""
    old = table.get(key)
    table[key] = value if old is None else max(old, value) + math.log1p(math.exp(-abs(old - value)))


def marginals(segments: list, stretch: list[int], weights: dict[str, float]) -> tuple[list[dict[str, float]], float]:
    """(for each segment of the stretch its probability by the kind before it, log of the sum over all segmentations): forward-backward."""
    spans, n = _places(segments, stretch)
    kinds = [segments[k][4] for k in stretch]
    score = [sum(weights.get(f, 0.0) for f in segments[k][5]) for k in stretch]
    by_end: list[list[int]] = [[] for _ in range(n)]
    for j, (_, end) in enumerate(spans):
        by_end[end].append(j)
    ahead: list[dict[str, float]] = [{"O": 0.0}]
    for t in range(1, n):
        here: dict[str, float] = {}
        for v in ahead[t - 1].values():
            _add(here, "O", v)
        for j in by_end[t]:
            for p, v in ahead[spans[j][0]].items():
                _add(here, kinds[j], v + weights.get(f"{p}>{kinds[j]}", 0.0) + score[j])
        ahead.append(here)
    behind: list[dict[str, float]] = [{} for _ in range(n)]
    behind[-1] = dict.fromkeys(ahead[-1], 0.0)
    by_start: list[list[int]] = [[] for _ in range(n)]
    for j, (start, _) in enumerate(spans):
        by_start[start].append(j)
    for t in range(n - 2, -1, -1):
        for p in ahead[t]:
            _add(behind[t], p, behind[t + 1]["O"])
            for j in by_start[t]:
                _add(behind[t], p, weights.get(f"{p}>{kinds[j]}", 0.0) + score[j] + behind[spans[j][1]][kinds[j]])
    total = behind[0]["O"]
    probs = [{p: math.exp(v + weights.get(f"{p}>{kinds[j]}", 0.0) + score[j] + behind[spans[j][1]][kinds[j]] - total) for p, v in ahead[spans[j][0]].items()} for j in range(len(stretch))]
    return probs, total


def train(labelled: list[tuple[str, list[tuple[int, int, str]]]], given: frozenset[str], epochs: int = 5, rate: float = 0.4, decay: float = 1e-5) -> dict[str, float]:
    """Weights of greatest conditional likelihood: adaptive gradient steps, one per stretch, with a small pull to 0. Deterministic."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    prepared = []
    for text, spans in labelled:
        segments, gold = lattice(text, given), set(spans)
        for stretch in chains(segments):
            right = [j for j, k in enumerate(stretch) if (segments[k][2], segments[k][3], segments[k][4]) in gold]
            place = _places(segments, stretch)[0]
            before = {}
            for j in right:  # the kind of the gold segment that ends where this one starts
                before[j] = next((segments[stretch[i]][4] for i in right if place[i][1] == place[j][0]), "O")
            prepared.append((segments, stretch, before))
    for _ in range(epochs):
        for segments, stretch, before in prepared:
            probs, _ = marginals(segments, stretch, weights)
            slope: dict[str, float] = {}
            for j, k in enumerate(stretch):
                kind, off = segments[k][4], (1.0 if j in before else 0.0) - sum(probs[j].values())
                if abs(off) > 1e-3:
                    for f in segments[k][5]:
                        slope[f] = slope.get(f, 0.0) + off
                for p, q in probs[j].items():
                    d = (1.0 if before.get(j) == p else 0.0) - q
                    if abs(d) > 1e-3:
                        slope[f"{p}>{kind}"] = slope.get(f"{p}>{kind}", 0.0) + d
            for f, g in slope.items():
                w = weights.get(f, 0.0)
                g -= decay * w
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = w + rate * g / math.sqrt(squares[f] + 1e-8)
    return weights


@cache
def trained_weights(given: frozenset[str], sentences: int = 3000, seed: int = 7) -> dict[str, float]:
    from .pii_training import labelled_texts

    return train(labelled_texts(sentences, seed, sorted(given)), given)
