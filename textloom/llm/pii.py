"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap; boosted trees score each with features of its format and of the words
before and after; a calibrated threshold per kind selects the redactions. The base kinds (``email``, ``ip``, ``card``, ``phone``)
follow their patterns and are always reported; the model adds kinds that have no safe pattern: national and 00 phone numbers, account numbers,
identity numbers, masked addresses, IPv6 addresses, birth dates, and looser forms of the base kinds.

No table labels such spans, so the trees are trained here on sentences written from a rule with a fixed seed (:func:`training_rows`). The rule has families of
contexts (forms, prose in three groups of languages, tables and chat) with cue words of their own; a part of the true data has no cue or a wrong one, and so has a
part of the look-alikes (order numbers, versions, dates, measures, prices, scores). The trees learn from three families, are calibrated on a
fourth, and get their thresholds from a fifth. Tests hold them against sentences written by hand and against the base patterns on documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import map_batches, quote_columns
from .secrets import redact, span_text

#: All kinds, in the order in which they are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "local_phone", "account", "identity", "masked_email", "ip6", "birth", "email_like", "ip_like", "card_like", "phone_like")
BASE = KINDS[:4]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match can only start where digits start, so long runs are read once
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: High-recall generators of the added kinds; bounded repeats keep them linear.
GENERATORS = (
    ("local_phone", re.compile(r"(?<![\w.+-])\(?0?[0-9]{2,5}\)?[ ./-][0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,3}(?![\w-])")),
    ("account", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("identity", re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    ("masked_email", re.compile(r"(?<![\w.])[A-Za-z0-9._-]{1,40} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,40} ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z]{2,12}(?!\w)")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("birth", re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![\w/-])")),
    ("email_like", re.compile(r"(?<![^\s<>\"(),;:])[^\s@<>\"(),;:]{1,64}@[^\s@<>\"(),;:]{1,190}")),
    ("ip_like", re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?!\w)")),
    ("card_like", re.compile(r"(?<!\w)[0-9](?:[ .\u2013-]?[0-9]){12,18}(?!\w)")),
    ("phone_like", re.compile(r"(?<!\w)(?:\+|00)[1-9][0-9]?[0-9 ()./\u2013-]{6,18}[0-9](?!\w)")),
)
#: What a text must have before its generator is run at all.
DIGIT, AT, COLONS, MASKED = re.compile("[0-9]"), re.compile("@"), re.compile("[0-9A-Fa-f]:[0-9A-Fa-f:]|::"), re.compile(r"[\[(](?:at|AT)[\])]")
#: Words that speak for or against personal data nearby, in the languages of the texts.
FOR = frozenset(
    "phone tel telephone call mobile cell fax contact reach ring whatsapp iban account bank transfer ssn social security passport mail email address host server ipv6 login born birth birthday dob patient name card visa credit "
    "telefon handy anrufen rufnummer erreichbar konto überweisung bankverbindung ausweis geboren geburtsdatum geburtstag anschrift karte kreditkarte "
    "téléphone portable appeler joindre compte virement né née naissance courriel adresse carte teléfono móvil llamar cuenta transferencia nacido nacida nacimiento correo dirección tarjeta".split())  # fmt: skip
AGAINST = frozenset(
    "order invoice version release isbn issn ref reference part page pages price total chapter score ratio published updated time date code model sku serial tracking ticket build size item "
    "bestellung rechnung fassung seite seiten preis summe kapitel stand datum modell artikel sendung bestellnummer "
    "commande facture page prix somme chapitre date modèle article colis pedido factura página precio suma capítulo fecha modelo artículo envío".split())  # fmt: skip
WINDOW = 60
WORDS = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds by their patterns: leftmost, non-overlapping for each kind, failing matches dropped."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:  # from each @ outwards, so that long runs without one cost nothing
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and not NOT_LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    some = {"masked_email": MASKED, "ip6": COLONS, "email_like": AT}
    return [(m.start(), m.end(), kind) for kind, pattern in GENERATORS if some.get(kind, DIGIT).search(text) for m in pattern.finditer(text)]


def _date(text: str) -> tuple[bool, int]:
    """Whether numbers are a day, month and year, and the year."""
    n = [int(g) for g in re.findall(r"[0-9]{1,9}", text)]
    if len(n) != 3:
        return False, 0
    year, month, day = n if n[0] > 31 else n[::-1]
    return 1 <= month <= 12 and 1 <= day <= 31, year


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, then its context."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    raw = text[max(0, start - WINDOW) : start]
    before, after = raw.lower(), text[end : end + WINDOW].lower()
    words = WORDS.findall(before)
    near, wide = words[-3:], words + WORDS.findall(after)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    numbers = [int(g) for g in re.findall(r"[0-9]{1,9}", s)]
    last, (is_date, year) = before.rstrip()[-1:], _date(s)
    return [
        KINDS.index(kind), len(s), len(digits), len(set(digits)), len(groups), max(groups, default=0), min(groups, default=0), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"),
        s.startswith("0"), s.startswith("("), s.startswith("+"), kind == "account" and iban(s), bool(digits) and luhn(digits), is_date, year, max(numbers, default=0), min(numbers, default=0),
        s.rpartition("@")[2].count("."), sum(w in FOR for w in near), sum(w in FOR for w in wide), sum(w in AGAINST for w in near), sum(w in AGAINST for w in wide), last == ":", last == "#", last == "|", last in "$€£" and last != "",
        after[:1] in "%$€£" and after != "", after[:1].isalnum(), sum(c.isdigit() for c in raw + after), bool(words) and raw.rstrip()[-len(words[-1]) :][:1].isupper(),
    ]


#: For each family of contexts, leads of true data by kind, leads of look-alikes, and leads that say nothing, parted by semicolons.
FAMILIES = (
    ("form", {"phone": "Phone: ;Tel. ;Fax: ;Mobile: ", "account": "IBAN: ;Account: ;Bank account ", "identity": "SSN: ;Social security number: ", "mail": "E-mail: ;Contact: ", "net": "Host: ;Server address: ", "birth": "Date of birth: ;DOB: ;Born: ", "card": "Card: ;Credit card: "},
     "Order no. ;Invoice: ;Version ;Ref. ;Part ;SKU: ;ISBN ;Total: ;Page ;Build ;Tracking: ;Updated: ;Score: ;Size ", "Value: ;Field 3: ;No. ;"),
    ("english", {"phone": "please call ;you can reach me on ;ring my mobile on ;our fax is ", "account": "transfer it to my account ;the bank gave me ", "identity": "my social security number is ;her passport says ", "mail": "write a mail to ;contact ", "net": "the login came from server ;the host answers at ", "birth": "she was born on ;the patient, born ;his birthday is ", "card": "I paid with my card ;the credit card "},
     "the order ;chapter ;see pages ;release ;the price was ;it was published on ;the final score was ;a ratio of ;ticket ;model number ;last updated on ", "and then ;there was ;we saw ;about ;on ;in "),
    ("german", {"phone": "Sie erreichen mich unter Telefon ;mein Handy ;bitte anrufen: ", "account": "Überweisung auf Konto ;Bankverbindung ", "identity": "Ausweis ;Social Security ", "mail": "Mail an ;Anschrift ", "net": "der Server ;Host ", "birth": "geboren am ;Geburtsdatum ;Geburtstag am ", "card": "Karte ;Kreditkarte "},
     "Bestellung ;Rechnung ;Fassung ;Seite ;der Preis ;Stand ;Artikel ;Modell ;Sendung ;Kapitel ", "und dann ;es waren ;wir sahen ;am ;im "),
    ("romance", {"phone": "mon téléphone est le ;vous pouvez me joindre au ;mi teléfono es el ;llamar al móvil ", "account": "virement sur le compte ;transferencia a la cuenta ", "identity": "passport ;social security ", "mail": "un courriel à ;un correo a ;adresse ", "net": "login au host ;server ", "birth": "née le ;né le ;nacida el ;fecha de nacimiento ", "card": "ma carte ;mi tarjeta "},
     "commande ;facture ;page ;le prix ;pedido ;precio ;artículo ;envío ;chapitre ;modèle ;fecha ", "et puis ;il y avait ;y luego ;había ;le ;en "),
    ("table", {"phone": "| tel | ;|mobile | ;hey call me ;ring ", "account": "| iban | ;|bank | ;send it to account ", "identity": "| ssn | ;|social security | ", "mail": "| mail | ;|my email lol ", "net": "| host | ;|ipv6 | ;|server | ", "birth": "| born | ;|dob | ;|birthday | ", "card": "| visa | ;|card | "},
     "| order | ;| ref | ;|sku | ;|tracking | ;|page | ;|version | ;score lol ;|total | ;|updated | ", "| ;|x | ;ok ;lol "),
)
CUES = {"local_phone": "phone", "phone_like": "phone", "account": "account", "identity": "identity", "masked_email": "mail", "email_like": "mail", "ip6": "net", "ip_like": "net", "birth": "birth", "card_like": "card"}


def training_rows(n: int = 9000, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and family of ``n`` sentences or more, written from a rule: the same at every call."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvwäéñ") for _ in range(int(rng.integers(2, 9))))
    low = lambda k: str(rng.integers(1, k))

    def account(ok: bool) -> str:
        body, country = num(int(rng.integers(12, 19))), pick(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{check if ok else (check + int(rng.integers(1, 90))) % 97:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def card(ok: bool) -> str:
        while True:
            d = pick("345") + num(pick([14, 15]))
            if luhn(d) == ok:
                return d if rng.random() < 0.4 else pick(" .-").join(d[i : i + 4] for i in range(0, len(d), 4))

    local = lambda: pick([f"0{num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)}-{num(4)}-{num(4)}", f"0{num(4)}/{num(5)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{low(10)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}-{num(3)}-{num(4)}"])
    date = lambda: pick([f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1930, 2024)}", f"{rng.integers(1930, 2024)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1930, 2024)}"])
    v6 = lambda: ":".join(f"{int(rng.integers(0, 65536)):x}" for _ in range(8)) if rng.random() < 0.6 else f"{int(rng.integers(4096, 65536)):x}:{num(3)}::{num(1)}"
    quad = lambda sep: sep.join(str(rng.integers(1, 256)) for _ in range(4))
    identity = lambda: f"{num(3)}-{num(2)}-{num(4)}"
    true = {
        "local_phone": local, "account": lambda: account(True), "identity": identity, "masked_email": lambda: f"{word()}{pick([' [at] ', '(at)', '[at]'])}{word()}{pick(['.', ' [dot] '])}com", "ip6": v6, "birth": date,
        "email_like": lambda: f"{word()}{pick(['', '.' + word()])}@{word()}.{pick(['com', 'de', 'fr', 'org'])}", "ip_like": lambda: quad(pick([".", "[.]"])), "card_like": lambda: card(True), "phone_like": lambda: f"{pick(['+', '00'])}{low(99)} {num(2)} {num(3)} {num(4)}",
    }
    false = {
        "local_phone": lambda: pick([f"{num(4)}-{num(2)}-{num(2)}", f"{low(99)} {num(3)}", f"{num(4)} {num(4)}", f"{num(2)}/{num(2)}", f"{num(3)}-{num(4)}", f"{num(3)}.{num(3)}", f"{low(99)}.{low(99)}.{low(99)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}-{low(10)}{num(2)}-{num(4)}", quad(".")]),
        "account": lambda: account(False), "identity": identity, "masked_email": lambda: f"{word()} (at) {word()} .{word()}", "ip6": lambda: pick([f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}", f"{low(9)}:{low(9)}:{low(9)}"]), "birth": date,
        "email_like": lambda: pick([f"@{word()}", f"{word()}@{low(99)}", f"{num(2)}@{num(2)}", f"{word()}@{word()}"]), "ip_like": lambda: f"{low(12)}.{low(20)}.{low(9)}.{num(3)}", "card_like": lambda: pick([card(False), f"978-{low(9)}-{num(4)}-{num(4)}-{low(9)}", num(13), num(18)]), "phone_like": lambda: f"00{low(99)} {num(3)}-{num(4)}",
    }
    x, y, fam = [], [], []
    patterns = dict(GENERATORS)
    while len(y) < n:
        ok, f = rng.random() < 0.5, int(rng.integers(len(FAMILIES)))
        kind = pick(list(true))
        _, leads, against, nothing = FAMILIES[f]
        own, other = leads[CUES[kind]].split(";"), against.split(";")
        draw, r = [own, other] if ok else [other, own], rng.random()
        lead = pick(draw[0]) if r < 0.83 else pick(nothing.split(";")) if r < 0.98 else pick(draw[1])  # a part has no cue, or a wrong one
        filler = lambda: " ".join(word() if rng.random() < 0.9 else num(2) for _ in range(int(rng.integers(1, 8))))
        start = f"{filler()} {lead}"
        text = f"{start}{(true if ok else false)[kind]()}{pick(['', '.', ',', ' ', ' |'])} {filler()}"
        found = [m for m in patterns[kind].finditer(text) if m.start() >= len(start) - 1][:1]
        x += [features(text, m.start(), m.end(), kind) for m in found]
        y += [float(ok)] * len(found)
        fam += [f] * len(found)
    return np.array(x, float), np.array(y), np.array(fam)


@cache
def trained(precision: float = 0.95) -> tuple[BoostedTrees, dict[str, float]]:
    """The model and the threshold of each added kind, from families of contexts of their own: three to fit, one to calibrate, one to set thresholds (at least a half)."""
    x, y, fam = training_rows()
    model = BoostedTrees().fit(x[fam < 3], y[fam < 3]).calibrate(x[fam == 3], y[fam == 3])
    x, y = x[fam == 4], y[fam == 4]
    return model, {k: max(0.5, model.threshold(x[x[:, 0] == i], y[x[:, 0] == i], precision)) if (x[:, 0] == i).any() else 1.1 for i, k in enumerate(KINDS) if k not in BASE}


def find_spans(text: str, model: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[int, int, str]]:
    """Base spans, and selected candidates that no better candidate or base span overlaps; by kind as listed, then start."""
    base = base_spans(text)
    found = candidates(text)
    if found:
        p = model.probability(np.array([features(text, *c) for c in found], float))
        covered = bytearray(len(text))
        for s, e, _ in base:
            covered[s:e] = b"\1" * (e - s)
        for _, (s, e, k) in sorted(((q, c) for q, c in zip(p, found, strict=True) if q >= thresholds[c[2]]), key=lambda z: (-z[0], z[1])):
            if not any(covered[s:e]):
                base.append((s, e, k))
                covered[s:e] = b"\1" * (e - s)
    return sorted(base, key=lambda z: (KINDS.index(z[2]), z[0], z[1]))


def scan_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """``id_col``, counts of the base kinds, ``base_sha256``, ``spans`` (all, as kind:start:end) and ``redacted``.

    One pass without shuffle, in Arrow batches of bounded bytes; the model has a fixed size. Null and empty texts have no
    spans (redacted stays null or empty); repeated rows each get a row; further columns are ignored.
    """
    model, thresholds = trained(precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = find_spans(text or "", model, thresholds)
                base = [s for s in spans if s[2] in BASE]
                kinds = [s[2] for s in base]
                rows.append((*map(kinds.count, BASE), hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans), redact(text, spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]], [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(*quote_columns(docs, id_col, text_col)), run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
